"""What the driver holds while models are learned, and the tables that stages leave."""

import os
import tracemalloc

from terracell.llm import kn_lang, toxicity
from terracell.llm.shared import fitted, materialise

TEXT = "concat_ws(' ', transform(sequence(1, 3000), i -> substr(md5(concat(id, '.', i)), 1, 8)))"


def _peak(run):
    tracemalloc.start()
    try:
        found = run()
        return found, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _docs(spark):
    docs = spark.range(400).selectExpr("id as doc_id", f"{TEXT} as text", "'en' as lang")
    return docs, 400 * 27000


def test_driver_does_not_hold_the_sample_of_languages(spark):
    docs, size = _docs(spark)
    m, peak = _peak(lambda: kn_lang.learn(docs))
    assert m.langs == ["en"] and len(m.keys) == kn_lang.ORDER
    assert peak < size / 4


def test_driver_does_not_hold_the_sample_of_labels(spark):
    docs, size = _docs(spark)
    docs = docs.selectExpr("doc_id", "if(doc_id % 2 = 1, concat('grobian grobian ', text), text) as text")
    labels = spark.range(400).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    lex, peak = _peak(lambda: toxicity.learn(docs, labels))
    assert any(s.startswith("grob") for s in lex.weights)
    assert peak < size / 4


def test_fits_all_rows_in_one_task_of_an_executor(spark):
    rows = spark.range(0, 1000, 1, 7)
    pid, n, total = fitted(rows, lambda r: (os.getpid(), len(r), sum(x["id"] for x in r)))
    assert pid != os.getpid() and (n, total) == (1000, 499500)
    assert fitted(rows.where("id < 0"), len) == fitted(rows.where("false"), len) == 0


def test_garbage_of_the_driver_goes_with_a_written_table(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = next(b for b in beans if "Old" in b.getName())
    before = full.getCollectionCount()
    assert materialise(spark.range(10).toDF("n"), "test-garbage").count() == 10
    assert full.getCollectionCount() > before
