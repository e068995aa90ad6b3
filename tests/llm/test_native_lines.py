"""Line dedup runs DataFrame functions only, and holds the lines of large keys in blocks."""

import random

from pyspark.sql import functions as F

from millrace.llm import lines


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8)))


def with_passage(rng, n):
    """n lines of 20 words of their own and a passage of 30 words, and a near copy of each tenth."""
    passage = [word(rng) for _ in range(30)]
    own = [[word(rng) for _ in range(20)] for _ in range(n)]
    own += [[*w[:7], word(rng), *w[8:]] for w in own[::10]]
    return [(i, " ".join([*w, *passage])) for i, w in enumerate(own)]


def test_no_python_on_the_executors(spark, monkeypatch):
    plans, write = [], lines.stored
    monkeypatch.setattr(lines, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    rows = [(i, f"{text}\nand another line that all of these have") for i, text in with_passage(random.Random(1), 20)]
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert {r.doc_id for r in got.filter("text = ''").collect()} == {20, 21}
    assert len(plans) > 5
    assert not [p for p in plans if any(x in p for x in ("MapInArrow", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"))]


def test_unlike_lines_of_one_key_make_no_row_for_each_pair(spark, monkeypatch):
    rows = with_passage(random.Random(2), 150)
    held, verify = [], lines._verified
    monkeypatch.setattr(lines, "BLOCK", 16, raising=False)
    monkeypatch.setattr(lines, "_verified", lambda pairs, classes: held.append(pairs.count()) or verify(pairs, classes))
    got = {r.id: r.component for r in lines.near_lines(spark.createDataFrame(rows, "id long, norm string")).collect()}
    assert [got.get(150 + k) for k in range(15)] == [10 * k for k in range(15)]
    assert sum(held) < 10 * len(rows)


def test_blocks_find_each_pair(spark):
    rng = random.Random(3)
    texts = dict(with_passage(rng, 90))
    texts |= {200 + i: " ".join([*t.split()[:2], *t.split()[3:]]) for i, t in list(texts.items())[:20]} | {300: "one", 301: "one two", 302: "ones"}
    classes = spark.createDataFrame(list(texts.items()), "id long, norm string")
    rows = classes.select("id", F.char_length("norm").alias("len"), F.lit(0).cast("long").alias("sketch"), F.lit(0).alias("level"), (F.col("id") % 60).alias("component"))
    rows = rows.withColumn("key", F.explode(F.array(F.lit(7).cast("long"), F.lit(8).cast("long"))))
    rows = rows.withColumns({"n": F.lit(len(texts)), "chars": F.lit(10 * lines.BLOCK_CHARS)})
    got = [(r.a, r.b) for r in lines._linked_in_blocks(rows, classes).collect()]
    near = lambda x, y: lines.within(x, y, int(max(len(x), len(y)) * 0.2 + 1e-9))
    want = {(a, b) for a in texts for b in texts if a < b and a % 60 != b % 60 and near(texts[a], texts[b])}
    assert len(want) > 20 and len(got) == len(set(got)) and set(got) == want


def test_distances_are_those_of_the_whole_lines(spark):
    rng = random.Random(4)
    words, rows = [word(rng) for _ in range(30)], []
    for _ in range(400):
        one = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        two = list(one)
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(0, len(two))
            two[at : at + rng.randint(0, 2)] = [rng.choice(words)[: rng.randint(1, 8)]] * rng.randint(0, 2)
        if one != two and two:
            rows.append((" ".join(one), " ".join(two), rng.randint(0, 20)))
    df = spark.createDataFrame(rows, "x string, y string, most int")
    for r in df.withColumn("near", lines._near(F.split("x", " "), F.split("y", " "), F.col("most"))).collect():
        assert r.near == lines.within(r.x, r.y, r.most), r
