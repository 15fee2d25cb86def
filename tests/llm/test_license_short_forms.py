import pyarrow as pa
import pytest

from terracell.llm import license_scan, textbatch
from tests.llm.test_license_scan import DATA, PLANTED

SHORT = {"All rights reserved.": "Proprietary", "MIT License": "MIT", "Apache License": "Apache-2.0", "BSD License": "BSD", "ISC License": "ISC", "CC BY 4.0": "CC-BY", "Mozilla Public License": "MPL-2.0", "GNU General Public License": "GPL"}
PROSE = ["the license plate of a car", "all rights of way are reserved for the cars", "a public road", "of the", "to any person", "this work is long"]


@pytest.fixture(scope="module")
def model(spark):
    return license_scan.learn(spark.read.parquet(f"{DATA}/documents.parquet"))


def hits(model, texts):
    return [h for _, part in textbatch.slices(pa.array(texts)) for h in model.hits(part)]


def test_short_forms_are_found(model):
    got = hits(model, [f"a hill\n{x}\nthe cat" for x in SHORT])
    assert [[(h[0], h[1]) for h in x] for x in got] == [[(1, f)] for f in SHORT.values()]


def test_prose_is_not(model):
    assert not any(hits(model, PROSE))


def test_all_five_planted_lines_are_found(spark):
    rows = license_scan.scan(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")).collect()
    assert any("Proprietary" in [h.family for h in r._licenses] for r in rows)
    for r in rows:
        want = [(i, PLANTED[x]) for i, x in enumerate(r.text.split("\n")) if x in PLANTED]
        assert [(h.line, h.family) for h in r._licenses] == want
