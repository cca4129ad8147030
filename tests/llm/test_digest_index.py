"""The digest index over several batches and sessions."""

from __future__ import annotations

import hashlib
import random
import re

from tests_llm_data import documents


def test_index_is_opened_again(spark, tmp_path):
    from tidewright.llm.digest_index import DigestIndex, digests

    r = random.Random(3)
    texts = [f"text {r.randrange(60)}" for _ in range(300)]
    kept = {}
    for batch in range(3):
        part = list(enumerate(texts))[batch * 100 : (batch + 1) * 100]
        r.shuffle(part)
        for i, t in sorted(part):
            kept.setdefault(t, (i, batch))
        rows = digests(spark.createDataFrame(part, "doc_id long, text string").repartition(3))
        index = DigestIndex(spark, str(tmp_path / "index"), buckets=3 if batch == 0 else None)
        index.add(rows, batch)
        index.add(rows, batch + 10)  # as after a lost driver
        got = {bytes(x.digest): (x.id, x.batch) for x in index.table().collect()}
        assert index.buckets == 3 and got == {hashlib.sha256(t.encode()).digest(): v for t, v in kept.items()}
        index.close()


def test_old_rows_stay_and_plan_has_one_side_in_buckets(spark, tmp_path):
    from tidewright.llm.digest_index import DigestIndex, digests, verdicts

    index = DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(digests(spark.createDataFrame([(7, "a b"), (8, "c")], "doc_id long, text string")), 0)
    new = digests(spark.createDataFrame([(1, "a  b"), (2, "d"), (3, "d"), (4, None), (5, "")], "doc_id long, text string"))
    plan = new.hint("merge").join(index.table(), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and len(re.findall(r"Exchange hashpartitioning", plan.split("== Physical Plan ==")[1])) == 1
    index.add(new, 1)
    got = {x.id: (x.keep_id, x.group_size, x.kept) for x in verdicts(new, index.table()).collect()}
    assert got == {1: (7, 1, False), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 2, True), 5: (4, 2, False)}
    index.delete()
    assert not (tmp_path / "index").exists()


def test_string_ids_come_in_one_batch(spark):
    from tidewright.llm.digest_index import drop_copies

    docs = spark.createDataFrame([(str(i), t) for i, t in documents(n=40)], "name string, body string")
    got = drop_copies(docs, "name", "body").collect()
    least = {}
    for x in got:
        least[x.text_sha256] = min(least.get(x.text_sha256, x.name), x.name)
    assert len(got) == docs.count() and all(x.keep_id == least[x.text_sha256] and x.kept == (x.name == x.keep_id) for x in got)


def test_repeated_groups_stay_off_the_driver(spark, tmp_path):
    """Small groups are estimated under the limit of broadcasts, which their repetition may be far beyond."""
    from tidewright.llm.digest_index import DigestIndex, digests, verdicts

    rows = digests(spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id long, text string"))
    index = DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(rows, 0)
    out = verdicts(rows, index.table())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(x.id, x.keep_id, x.group_size, x.kept) for x in out.collect()} == {(i, i // 2 * 2, 2, i % 2 == 0) for i in range(400)}
    index.delete()
