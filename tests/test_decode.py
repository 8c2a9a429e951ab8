"""Frame decoding against written-out cases and against a separate strict reader."""

import json
import random

import pytest
from strict_reader import read_frame

from conftest import plan_of
from ticktape import schemas as S
from ticktape.operators import decode

TRADE = '{"ev":"XT","pair":"BTC-USD","p":45000.5,"t":1704067200000,"s":0.5,"c":[1],"i":"t1","x":1,"r":1704067200005}'
QUOTE = '{"ev":"XQ","pair":"ETH-USD","bp":2300.1,"bs":1.5,"ap":2300.4,"as":2.0,"t":1704067200000,"x":1,"r":1704067200005}'
MINUTE = '{"ev":"XA","pair":"BTC-USD","o":100.0,"c":101.5,"h":102.0,"l":99.5,"v":12.5,"s":1,"e":60001,"vw":100.9,"z":0}'
SECOND = MINUTE.replace("XA", "XAS")
BOOK = '{"ev":"XL2","pair":"BTC-USD","t":1,"r":2,"x":1,"b":[[45000.0,1.0],[44999.5,2]],"a":[[45001.0,0.5]]}'

OK, BAD, UNKNOWN, MISMATCH = "trade", S.BAD_JSON, S.UNKNOWN_EVENT_TYPE, S.SCHEMA_MISMATCH


def _with(old, new):
    assert old in TRADE
    return TRADE.replace(old, new)


CASES = [
    (TRADE, [OK]),
    (QUOTE, ["quote"]),
    (MINUTE, ["bar"]),
    (SECOND, ["bar"]),
    (BOOK, ["book"]),
    (f'[{TRADE},{{"ev":"status","message":"connected"}}]', [OK, UNKNOWN]),
    (f" [ {TRADE} , {QUOTE} , {BOOK} ]\t", [OK, "quote", "book"]),
    ("[]", []),
    (" [ ] ", []),
    ('{"ev":', [BAD]),
    ("", [BAD]),
    (" ", [BAD]),
    ('{"ev":"XT"} zzz', [BAD]),
    (TRADE + "] z", [BAD]),
    (TRADE + TRADE, [BAD]),
    (f"{TRADE},{TRADE}", [BAD]),
    (f"[{TRADE}],[{TRADE}]", [BAD]),
    (f"[{TRADE}]]", [BAD]),
    (TRADE.replace('"', "'"), [BAD]),
    (_with("45000.5", "NaN"), [BAD]),
    (_with("45000.5", "1e400"), [BAD]),
    (_with('"p"', '"zz":-1e999,"p"'), [BAD]),
    (_with("45000.5", "9" * 400), [BAD]),
    (_with('"p"', f'"zz":[1,{"9" * 400}],"p"'), [BAD]),
    (_with('"t1"', '"' + "9" * 400 + '"'), [OK]),
    (_with("45000.5", "9" * 308), [OK]),
    (_with("45000.5", "0." + "9" * 400), [OK]),
    ("[1e400]", [BAD]),
    ("[-1e400,7]", [BAD]),
    (f'["xInfinity",{TRADE.replace("45000.5", "1e400")}]', [BAD]),
    (f'["xInfinity",{TRADE}]', [UNKNOWN, OK]),
    (_with('"t1"', '"\\u0049nfinity"'), [OK]),
    (_with('"t1"', '"Infinity 1e400"'), [OK]),
    (_with('"t1"', '"a:-0,b"').replace("45000.5", "-0"), [OK]),
    (_with('"t1"', '"\\":-0,"').replace("45000.5", "-0"), [OK]),
    (_with("45000.5", "-0") + '"', [BAD]),
    (_with("45000.5", "01"), [BAD]),
    (_with('"t1"', '"\\ud800"'), [BAD]),
    (_with('"t1"', '"\\udc00\\ud800"'), [BAD]),
    (_with('"t1"', '"\\ud83d\\ude00"'), [OK]),
    (_with('"t1"', '"\\\\ud800"'), [OK]),
    (_with('"t1"', '"Infinity"'), [OK]),
    (_with('"t1"', '"a\tb"'), [BAD]),
    ("[" * 127 + "]" * 127, [UNKNOWN]),
    ("[" * 128 + "]" * 128, [BAD]),
    ('{"a":' * 127 + "1" + "}" * 127, [UNKNOWN]),
    ('{"a":' * 128 + "1" + "}" * 128, [BAD]),
    (_with("XT", "xt"), [UNKNOWN]),
    (_with('"ev"', '"EV"'), [UNKNOWN]),
    ('{"ev":5}', [UNKNOWN]),
    ("{}", [UNKNOWN]),
    ("7", [UNKNOWN]),
    ("null", [UNKNOWN]),
    ('[7,"q",["q"],null,true,{}]', [UNKNOWN] * 6),
    (f"[[{TRADE}]]", [UNKNOWN]),
    (json.dumps(TRADE), [UNKNOWN]),
    (json.dumps([TRADE]), [UNKNOWN]),
    (f"[{json.dumps(TRADE)},{TRADE}]", [UNKNOWN, OK]),
    ('["{}"]', [UNKNOWN]),
    (_with('"ev":"XT"', '"ev":"XQ","ev":"XT"'), [OK]),
    (_with('"ev":"XT"', '"ev":"XT","ev":5'), [UNKNOWN]),
    (_with('"ev":"XT"', '"zz":{"ev":"XT"}'), [UNKNOWN]),
    (_with('"ev":"XT"', '"zz":{"ev":"XQ"},"ev":"XT"'), [OK]),
    (_with("XT", "\\u0058T"), [OK]),
    (_with('"p"', '"\\u0070"'), [OK]),
    (_with(',"r":1704067200005', ""), [MISMATCH]),
    (_with('"r":1704067200005', '"r":null'), [MISMATCH]),
    (_with("1704067200000", "1.0"), [MISMATCH]),
    (_with("1704067200000", "1e3"), [MISMATCH]),
    (_with("1704067200000", "-0"), [MISMATCH]),
    (_with("1704067200000", "9223372036854775807"), [OK]),
    (_with("1704067200000", "9223372036854775808"), [MISMATCH]),
    (_with("45000.5", '"45000"'), [MISMATCH]),
    (_with("45000.5", "45000"), [OK]),
    (_with("45000.5", "-0"), [OK]),
    (_with("45000.5", "123456789012345678901234567890"), [OK]),
    (_with("45000.5", "true"), [MISMATCH]),
    (_with('"BTC-USD"', "123"), [MISMATCH]),
    (_with('"BTC-USD"', '{"pair":"x"}'), [MISMATCH]),
    (_with('"BTC-USD"', '""'), [OK]),
    (_with('"t1"', "5"), [MISMATCH]),
    (_with('"t1"', '"5"'), [OK]),
    (_with('"t1"', "null"), [OK]),
    (_with('"t1"', "[]"), [MISMATCH]),
    (_with('"t1"', '"q\\"i\\":\\""'), [OK]),
    (_with(',"i":"t1"', ""), [OK]),
    (_with("[1]", "[]"), [OK]),
    (_with("[1]", "[1,null]"), [MISMATCH]),
    (_with("[1]", '[1,"x"]'), [MISMATCH]),
    (_with("[1]", "[1.0]"), [MISMATCH]),
    (_with("[1]", "{}"), [MISMATCH]),
    (_with('"p"', '"zz":1,"p"'), [OK]),
    (_with('"p"', '"zz":{"a":1,"a":2},"p"'), [OK]),
    (_with('"p":45000.5', '"p":1,"p":"x"'), [MISMATCH]),
    (_with('"p":45000.5', '"p":"x","p":1'), [OK]),
    (_with('"p":45000.5', '"p":1,"p":null'), [MISMATCH]),
    (_with('"t":1704067200000', '"t":1,"t":1.0'), [MISMATCH]),
    (_with('"t":1704067200000', '"t":1.5,"t":1'), [OK]),
    (_with('"p":45000.5', '"p":1,"p":{"a":1,"a":2}'), [MISMATCH]),
    (_with('"p":45000.5', '"p":{"a":1,"a":2},"p":1'), [OK]),
    (_with('"c":[1]', '"c":[1],"c":[{"a":1,"a":2}]'), [MISMATCH]),
    (_with('"i":"t1"', '"i":null,"i":{"a":1,"a":2}'), [MISMATCH]),
    (_with('"i":"t1"', '"i":"x","i":{"a":1,"a":2}'), [MISMATCH]),
    (_with('"i":"t1"', '"i":"x","i":"{y"'), [OK]),
    (_with('"i":"t1"', '"i":"5","i":5'), [MISMATCH]),
    (_with('"i":"t1"', '"i":5,"i":null'), [OK]),
    (_with('"c":[1]', '"c":[1],"c":["x"]'), [MISMATCH]),
    (_with('"c":[1]', '"c":["x"],"c":[2]'), [OK]),
    (MINUTE.replace('"z":0', '"z":0.5'), [MISMATCH]),
    (BOOK.replace("[[45001.0,0.5]]", "[]"), ["book"]),
    (BOOK.replace("[[45001.0,0.5]]", "[[]]"), ["book"]),
    (BOOK.replace("[[45001.0,0.5]]", "[null]"), [MISMATCH]),
    (BOOK.replace("[[45001.0,0.5]]", "[[1,null]]"), [MISMATCH]),
    (BOOK.replace("[[45001.0,0.5]]", '[[1,"2"]]'), [MISMATCH]),
    (BOOK.replace("[[45001.0,0.5]]", "[1]"), [MISMATCH]),
]


def _decode_all(spark, frames):
    """Per frame, what ``read_frame`` gives for it."""
    df = spark.createDataFrame(list(enumerate(frames)), "ingest_seq bigint, frame string").repartition(8)
    decoded = decode.decode(df)
    out = {i: [] for i in range(len(frames))}
    for name, family in S.FAMILIES.items():
        for r in decoded.family(name).collect():
            out[r.ingest_seq].append((r.pos, name, {c: r[c] for c in family.columns}))
    for r in decoded.rejects.collect():
        out[r.ingest_seq].append((r.pos, "reject", r.reason))
    return [sorted(out[i], key=lambda e: e[0]) for i in range(len(frames))]


@pytest.fixture(scope="module")
def decoded_cases(spark):
    return _decode_all(spark, [frame for frame, _ in CASES])


def test_written_out_cases(decoded_cases):
    got = [[e[2] if e[1] == "reject" else e[1] for e in events] for events in decoded_cases]
    wrong = [(frame, want, have) for (frame, want), have in zip(CASES, got) if want != have]
    assert not wrong


def test_cases_agree_with_the_strict_reader(decoded_cases):
    wrong = [(f, read_frame(f), have) for (f, _), have in zip(CASES, decoded_cases) if repr(read_frame(f)) != repr(have)]
    assert not wrong


def _random_frames(n, seed):
    rng = random.Random(seed)
    values = ["1", "-0", "1.0", "0", "-0.0", "2.5e3", "1e400", "null", '"x"', "[]", "[1]", "[1,null]", "[[1,2]]", "{}",
              "true", '"XT"', '"XQ"', '"a\\"b"', '"\\u0041"', '"-0"', "-12.5", '{"p":1}', "9223372036854775808",
              "7" * 400, '"a:-0,b"', '"Infinity"', '"\\u0049nfinity"', '"\\\\"']
    keys = ["ev", "pair", "p", "t", "s", "c", "i", "x", "r", "zz", "o", "a", "b"]
    edits = list('{}[]",:\\-0. e') + ['"ev":', '"p":1,', "null", "\\u", "zzz", "-0"]
    frames = []
    for _ in range(n):
        elements = []
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            element = rng.choice([TRADE, QUOTE, MINUTE, SECOND, BOOK])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                pair = f'"{rng.choice(keys)}":{rng.choice(values)}'
                element = rng.choice([element[:-1] + "," + pair + "}", "{" + pair + "," + element[1:]])
            if rng.random() < 0.3:
                old = rng.choice(['"BTC-USD"', "[1]", "1", '"t1"', "45000.5", '"XT"', "0.5", "[[45001.0,0.5]]"])
                element = element.replace(old, rng.choice(values), 1)
            elements.append(element)
        frame = elements[0] if len(elements) == 1 and rng.random() < 0.5 else "[" + ",".join(elements) + "]"
        if rng.random() < 0.35:
            at = rng.randrange(len(frame) + 1)
            frame = frame[:at] + rng.choice(["", *edits]) + frame[at + rng.choice([0, 1, 3]) :]
        if rng.random() < 0.05:
            frame = json.dumps([frame])
        if rng.random() < 0.03:
            frame = f"[{rng.choice(values)},{frame}]"
        frames.append(frame)
    return frames


def test_random_frames_agree_with_the_strict_reader(spark):
    frames = _random_frames(4000, seed=7)
    expected = [read_frame(f) for f in frames]
    kinds = {e[2] if e[1] == "reject" else e[1] for events in expected for e in events}
    assert kinds == {"trade", "quote", "bar", "book", BAD, UNKNOWN, MISMATCH}
    got = _decode_all(spark, frames)
    wrong = [(f, w, h) for f, w, h in zip(frames, expected, got) if repr(w) != repr(h)]
    assert not wrong, (len(wrong), wrong[:3])


def test_staged_equals_single_streams(spark):
    frames = [f for f, _ in CASES] + _random_frames(500, seed=11)
    df = spark.createDataFrame(list(enumerate(frames)), "ingest_seq bigint, frame string")
    staged, single = decode.stage_events(df).cache(), decode.decode(df)
    for name, family in S.FAMILIES.items():
        assert sorted(map(repr, decode.staged_family(staged, family).collect())) == sorted(
            map(repr, single.family(name).collect())
        )
    left = staged.where("family = 'reject'").select("ingest_seq", "pos", "raw", "reason")
    assert sorted(map(repr, left.collect())) == sorted(map(repr, single.rejects.collect()))


def test_a_long_frame_and_a_wide_book(spark):
    wide = BOOK.replace("[[45001.0,0.5]]", json.dumps([[float(i), 0.25] for i in range(5000)]))
    frames = ["[" + ",".join([TRADE] * 20000) + "]", wide]
    got = _decode_all(spark, frames)
    assert [e[1] for e in got[0]] == ["trade"] * 20000
    assert [e[0] for e in got[0]] == list(range(20000))
    assert len(got[1][0][2]["ask_prices"]) == 5000


def test_decoding_needs_no_shuffle_and_no_python(spark, tmp_path):
    path = str(tmp_path / "frames")
    spark.createDataFrame([(1, TRADE)], "ingest_seq bigint, frame string").write.parquet(path)
    frames = spark.read.schema("ingest_seq bigint, frame string").parquet(path)
    for df in (decode.decode(frames).trades, decode.decode(frames).rejects, decode.stage_events(frames)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


def test_strings_of_any_length_and_keys_up_to_the_parsers_limit(spark):
    """A key beyond the limit has a reason of its own: such a frame is JSON, only not for this parser."""
    long_text, key, too_long = "x" * 21_000_000, "k" * 40_000, "k" * 60_000
    texts = [TRADE[:-1] + f',"extra":"{long_text}"}}', TRADE[:-1] + f',"{key}":1}}', TRADE[:-1] + f',"{too_long}":1}}', '{"' + "x" * 60_000 + '"']
    decoded = decode.decode(spark.createDataFrame(list(enumerate(texts)), "ingest_seq bigint, frame string"))
    assert sorted(r.ingest_seq for r in decoded.trades.select("ingest_seq").collect()) == [0, 1]
    assert sorted(map(tuple, decoded.rejects.select("ingest_seq", "reason").collect())) == [(2, "name_too_long"), (3, "bad_json")]


def test_staging_some_families_reads_only_those(spark):
    texts = [TRADE, QUOTE, BOOK.replace('"t":', '"tt":'), TRADE.replace('"p":', '"pp":'), "oops", '{"ev":"status"}']
    frames = spark.createDataFrame(list(enumerate(texts)), "ingest_seq bigint, frame string")
    staged = decode.stage_events(frames, [S.TRADE])
    rows = sorted((r.ingest_seq, r.family, r.reason) for r in staged.collect())
    assert rows == [(0, "trade", None), (3, "reject", "schema_mismatch"), (4, "reject", "bad_json"), (5, "reject", "unknown_event_type")]
    assert staged.columns == ["ingest_seq", "pos", "family", "trade", "raw", "reason"]
