import random

import pytest
from odd_rows import none, odd

from ticktape.llm import licences, tables


@pytest.fixture(scope="module")
def model():
    return licences.fit(["the cat sat on the mat", "a river runs through the town", "all of the people may go there"])


def test_held_out_notices(model):
    rng, right, total = random.Random(99), 0, 0
    for family, templates in licences.TEMPLATES.items():
        for template in templates:
            for _ in range(10):
                _, found = licences.scan(model, licences.varied(rng, template).upper())
                right += [f for f, _, _ in found] == [family]
                total += 1
    assert right / total > 0.9


def test_ordinary_text_has_no_licence(model):
    for text in [*licences.PLAIN, "My license expired.", "MIT students", "version 3", "", "  \n \n"]:
        assert licences.scan(model, text)[1] == [], text


def test_known_lines(model):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache", "All rights reserved.": "Proprietary",
        "Licensed under CC BY-SA 3.0": "CC-BY-SA",
    }
    text = "first line\n\n" + "\nmore text\n".join(lines) + "\nend"
    n, found = licences.scan(model, text)
    assert n == 2 + len(lines) + len(lines) - 1 and [f for f, _, _ in found] == list(lines.values())
    assert [line for _, _, line in found] == list(lines) and all(0.7 <= p <= 1 for _, p, _ in found)


def test_unknown_without_a_confirming_template(model):
    words = licences.words_of("mozilla mozilla mozilla")
    assert not licences.confirmed("MPL", words, model.triggers)
    assert licences.in_order("a b c d".split(), "x a c y d".split()) == 0.75


def test_scan_against_named_lines(spark, sf_dir):
    docs = tables.documents(spark, sf_dir)
    marks = {"GNU General Public License, version 3": "GPL", "CC BY-NC 4.0": "CC-BY-NC", "the MIT License": "MIT", "Apache License, Version 2.0": "Apache", "All rights reserved": "Proprietary"}
    rows = licences.scanned(docs, licences.train(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = {f for mark, f in marks.items() if mark.lower() in r["row"]["text"].lower()}
        assert {x["family"] for x in r["licences"]} == want


def test_odd_rows(spark):
    rows = licences.scanned(odd(spark), licences.train(odd(spark))).collect()
    assert len(rows) == odd(spark).count() and all(r["licences"] == [] for r in rows)
    assert {r["n_paragraphs"] for r in rows if not (r["row"]["text"] or "").strip()} == {0}
    assert licences.scanned(none(spark), licences.train(none(spark))).count() == 0


def test_notices_that_are_not_built_from_the_templates(model):
    def families(text):
        return [f for f, _, _ in licences.scan(model, text)[1]]

    tags = {
        "SPDX-License-Identifier: MIT": ["MIT"], "// SPDX-License-Identifier: Apache-2.0": ["Apache"], "# SPDX-License-Identifier: GPL-2.0+": ["GPL"],
        "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */": ["MIT", "Apache"], "SPDX-License-Identifier: CC-BY-NC-SA-4.0": ["CC-BY-NC"],
        "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": ["GPL"], "SPDX-License-Identifier: LicenseRef-mine": [],
    }
    titles = {
        "MIT License": ["MIT"], "Apache License, Version 2.0": ["Apache"], "Apache License": ["Apache"], "GNU GENERAL PUBLIC LICENSE": ["GPL"],
        "Mozilla Public License Version 2.0": ["MPL"], "The ISC License": ["ISC"], "BSD 3-Clause License": ["BSD"],
    }
    wraps = {
        "Licensed under the Apache\nLicense, Version 2.0 (the License);": ["Apache"], "# Released under\n# the MIT\n# License.": ["MIT"],
        "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted": ["BSD"],
        "Licensed under the Apache\n\nLicense": [],
    }
    for text, want in [*tags.items(), *titles.items(), *wraps.items()]:
        assert families(text) == want, text
    n, found = licences.notices(model, "SPDX-License-Identifier: MIT OR Apache-2.0\nsome words")
    assert n == 2 and len(found) == 1
