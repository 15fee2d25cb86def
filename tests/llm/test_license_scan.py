import re

from terracell.llm import license_scan

DATA = "/root/testdata/sf0.01"
PLANTED = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "All rights reserved.": "Proprietary",
}


def test_finds_the_lines_that_say_a_licence(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for r in license_scan.scan(docs.select("doc_id", "text")).collect():
        want = [(i, PLANTED[x]) for i, x in enumerate(r.text.split("\n")) if x in PLANTED]
        assert [(h.line, h.family) for h in r._licenses] == want
        assert bool(want) or not re.search("licen[sc]e|rights reserved", r.text, re.I)


def test_families_and_odd_texts():
    lines = [f"{a} {b} walks over the {c} hill" for a in ("one", "some", "no") for b in ("cat", "dog", "cow") for c in ("far", "near", "green")]
    model = license_scan.train(lines)
    import pyarrow as pa

    from terracell.llm import textbatch

    texts = [None, "", "\n\n", "word", *(f"a hill\n{n}\nthe cat" for x in license_scan.NOTICES.values() for n in x), "the license plate of a car was far away", "", "a permission slip"]
    found = [h for _, part in textbatch.slices(pa.array(texts)) for h in model.hits(part)]
    want = [f for f, x in license_scan.NOTICES.items() for _ in x]
    got = [(h[0][0], h[0][1]) if h else None for h in found[4 : 4 + len(want)]]
    assert got == [(1, f) for f in want]
    assert not any(found[:4]) and not any(found[4 + len(want) :])


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
