"""Each stage of the pipeline against a brute-force version, on its own input."""

import struct
import zlib

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from test_other_operators import brute_targets
from test_text_operators import brute_hits, brute_links

from trackloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        made = stage(spark, docs, sf)
        made.write.parquet(f"{folder}/{k}")
        out.append((docs, spark.read.parquet(f"{folder}/{k}")))
        docs = out[-1][1]
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_quality_keeps_good_and_drops_bad(spark):
    """On the next larger tables: the smallest have labels for eleven bad documents only.

    The stage is fitted on these labels, so this shows that it takes effect, not how well it does on others.
    """
    folder = "/root/testdata/sf0.01"
    kept = set(ids(P.quality_classifier(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)))
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1 and r.toxic == 0]
    junk = [r.doc_id in kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_one_of_each_class_stays(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    _, classes = brute_links(rows)
    assert ids(after) == sorted(d for d in classes if classes[d] == d)


def test_contaminated_documents_go(stages, spark, sf):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [r.doc_id for r in before.collect() if not (lambda n, hit, _: hit > 0 and 20 * hit >= n)(*brute_hits(r.text, items))]
    assert ids(after) == sorted(clean)


def test_mixture_meets_its_targets(stages):
    before, after = stages[3]
    size = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    was, now = size(before.collect()), size(after.collect())
    longest = max(len(r.text.split()) for r in before.collect())
    for source, target in brute_targets(was).items():
        assert abs(now.get(source, 0) - target) <= max(30, longest / 2)
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 2


def test_records_hold_all_tokens(stages):
    from tokenizers import Tokenizer

    before, after = stages[4]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in before.collect():
        own = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        want.append((r.doc_id, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    got = after.orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, good string, words long, view string, row long, key long, kept boolean, size string"


def hard_table(spark, sf):
    """Documents with columns that have the names of ones that stages make, null ids, null fields and repeated rows."""
    made = spark.read.parquet(f"{sf}/documents.parquet")
    more = [(None, "null id, a text of its own that is long enough to be counted as one", None, None, 7), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "repeated row with some words in it", "en", None, 5), (10**9 + 2, "repeated row with some words in it", "en", None, 5)]
    whole = made.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    return whole.select("*", F.lit("x").alias("good"), F.lit(1).cast("long").alias("words"), F.lit("v").alias("view"), F.lit(2).cast("long").alias("row"), F.lit(3).cast("long").alias("key"), F.lit(True).alias("kept"), F.lit("z").alias("size"))


def test_stages_bear_hard_tables(spark, sf, tmp_path):
    rows = hard_table(spark, sf)
    rows.write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        found = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert found.columns == docs.columns, name
            assert 0 < found.count(), name
            if k < 3:  # nothing names a row without an id, so no filter drops it; rows that are equal stay or go together
                assert found.where("doc_id is null").count() == 1, name
                assert found.where("doc_id = 1000000002").count() in (0, 2), name
        else:
            assert found.count() == docs.count()
        docs = found


def test_stages_bear_empty_tables(spark, sf):
    empty = hard_table(spark, sf).where("key < 0")
    for name, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
