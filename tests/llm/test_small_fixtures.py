"""Each operator on small tables with nulls, empty and long texts, ties, repeats, clashing columns, and nothing at all."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import lines, minhash, mixing, outliers, packing, passages, sharding, topk, toxicity, warc
from millrace.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    body = words(1, 300)
    near = [*body[:100], "changed", *body[101:]]
    passage = words(2, 60)
    return docs_of(
        spark,
        [
            (0, " ".join(body), "a"), (1, " ".join(body), "a"), (2, " ".join(near), "b"), (3, None, None), (4, "", "b"), (5, "one", "b"),
            (6, " ".join(words(3, 80) + passage + words(4, 80)), "c"), (7, " ".join(words(5, 90) + passage + words(6, 70)), "c"),
            (8, " ".join(words(7, 20_000)), None), (9, "one", "b"), (9, "one", "b"), (10, "é \t\n x y <|endoftext|> z", "a"), (None, "no id", "a"),
        ],
    )


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 4), (4, 10)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 8: 8, 9: 8}
    assert components(links.filter("false")).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(0, 0.3, (400, 12))
    v[60:90] = v[0]  # ties
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1050, [float("inf")] + [0.0] * 11), (1100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, x, 7) for i, x in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in topk.top_k(df, block_bytes=64 * 96, query_bytes=3 * 96).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints, ids = np.floor(v * 256).astype(np.int64), np.arange(400)
    assert set(got) == set(range(0, 400, 50))
    for q, found in got.items():
        want = topk.brute_force(ids, ints, ints[q], q, 5)
        assert sorted(found) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]
    assert topk.top_k(df.filter("false")).count() == 0


def test_topk_of_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(0, 1, (120, 4)) * 10.0 ** rng.integers(0, 7, (120, 1))
    ids = [i // 2 for i in range(120)]  # each id twice
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    ints = [[int(x) for x in row] for row in np.floor(v * 256)]
    want = []
    for a in range(120):
        if ids[a] % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(ints[a], ints[b], strict=True)), ids[b]) for b in range(120) if b != a)
            want += [(ids[a], n, i, -s) for n, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, topk.top_k(df, block_bytes=1000).collect())) == sorted(want) and len(want) == 20
    huge = spark.createDataFrame([(i, [1e16, 1.0]) for i in range(3)], df.schema)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge).collect()


def test_packing(spark, odd, nothing):
    from tokenizers import Tokenizer

    rows = packing.pack(odd).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted((r.doc_id is None, r.doc_id or 0, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in odd.collect())
    got, filled = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset and zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        filled[r.sequence_id] = r.offset + r.length
        got.setdefault((r.doc_id is None, r.doc_id or 0), []).append((r.start, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())))
    ids = {k: tuple(x for _, part in sorted(v) for x in part) for k, v in got.items() if k != (False, 9)}
    assert ids == {(a, b): c for a, b, c in want if (a, b) != (False, 9)}
    assert len(got[False, 9]) >= 2  # repeated rows are packed twice
    assert all(n == 2048 or n & (n - 1) == 0 for n in filled.values())
    assert packing.pack(nothing).count() == 0


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(cells, 3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_warc(spark):
    page = "<html lang='de'><head><title>A &amp; B</title><script>var x='</p>'</script></head><body><p>Hi<b>there</b></p><!-- no --><a href='/x'>l</a></body></html>"
    df = spark.createDataFrame([(1, "http://e.org/a", page, "x"), (2, None, None, "x"), (3, "http://e.org", "", "x")], "page_id long, url string, html string, content string")
    rows = {(r.page_id, r.warc_type): r for r in warc.derivatives(warc.responses_of(df)).collect()}
    assert len(rows) == 6 and rows[1, "conversion"].content == "A & B\nHithere\nl" and rows[2, "conversion"].content == ""
    meta = rows[1, "metadata"]
    assert "title: A & B" in meta.content and "outlink: http://e.org/x" in meta.content and "http-header-content-type: text/html" in meta.content
    assert meta.refers_to == rows[1, "conversion"].refers_to != meta.record_id
    assert meta.block_digest == warc.digest(meta.content.encode()) and bytes(meta.record).endswith(meta.content.encode() + b"\r\n\r\n")
    for kind in ("metadata", "conversion"):  # each record read back by its own bytes
        row = rows[1, kind]
        head, block = bytes(row.record).split(b"\r\n\r\n", 1)
        version, *fields = head.decode().split("\r\n")
        named = dict(f.split(": ", 1) for f in fields)
        assert version == "WARC/1.1" and named["WARC-Type"] == kind and block == row.content.encode() + b"\r\n\r\n"
        assert int(named["Content-Length"]) == len(block) - 4 and named["WARC-Block-Digest"] == warc.digest(block[:-4])
        assert named["WARC-Refers-To"] == row.refers_to and named["WARC-Refers-To-Payload-Digest"] == warc.digest(page.encode())
        assert named["WARC-Target-URI"] == "http://e.org/a" and "WARC-Target-URI" not in bytes(rows[2, kind].record).decode()
    assert warc.derivatives(warc.responses_of(df.filter("false"))).count() == 0


def test_long_and_malformed_pages_take_one_pass():
    import time

    for page in ("<!--" * 250_000, "<a" * 500_000, "<a href=" * 120_000, "<script>" * 125_000, "</script  " * 100_000, "< " * 500_000, "<title>" * 140_000, "&amp" * 250_000, "x > y < z <" * 90_000):
        began = time.perf_counter()
        list(warc.derive({"payload": page.encode(), "http_headers": None, "target_uri": None, "record_id": "r", "date": None}))
        assert time.perf_counter() - began < 5, page[:10]
    assert warc.page_text("a <b>b</b> < c<br>d<script>x</SCRIPT >e <!-- f --> g<p h>1 &lt; 2<style>i") == "a b < c\nd e g\n1 < 2"


def brute_groups(rows, size, percent):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sets, root


def test_near_duplicates(spark, nothing):
    rng = np.random.default_rng(5)
    base, rows = words(11, 120), []
    for i in range(120):  # a family from close to far, so that some chains only hold through others
        text = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 16))):
            text[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(200, None), (201, " "), (202, "One"), (203, "one"), (204, "one two"), (205, "two one"), (206, rows[0][1]), (207, " ".join(words(12, 20_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    sets, root = brute_groups(rows, 2, 80)
    ids = [i for i, _ in rows]
    for k, i in enumerate(ids):
        least = min(ids[j] for j in range(len(ids)) if root[j] == root[k])
        assert got[i] == (len(sets[k]), least, least == i)
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.distinct_documents(df)
    assert kept.columns == df.columns and kept.count() <= len(rows)


def test_texts_under_one_or_no_id_stay_apart(spark):
    copy = " ".join(words(31, 60))
    rows = [(1, copy, "a"), (2, copy, "a"), (2, " ".join(words(32, 60)), "a"), (2, " ".join(words(33, 60)), "b"), (None, copy, "a"), (None, None, "a"), (None, "", "b")]
    rows += [(None, " ".join(words(40 + i, 60)), "a") for i in range(6)] + [(None, " ".join(words(40, 60)), "b"), (3, " ".join(words(41, 59)), "c"), (2, " ".join(words(32, 60)), "a")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in minhash.distinct_documents(docs_of(spark, rows)).collect())
    want = [(False, 1, copy), (False, 2, rows[2][1]), (False, 2, rows[3][1]), (True, 0, ""), (True, 0, ""), (False, 3, rows[14][1])]
    assert got == sorted(want + [(True, 0, r[1]) for r in (rows[7], *rows[9:13])])


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 16, (300, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.permutation(minhash.SYMBOLS)[: minhash.RADIUS]] ^= 1
    assert (minhash.chunk_keys(a) == minhash.chunk_keys(b)).any(1).all()


def test_sharding(spark, odd, nothing):
    names = [f"s{i}" for i in range(7)]
    owner = sharding.claim_slots(names, 251)
    counts = np.bincount(owner, minlength=7)
    assert len(owner) == 251 and min(owner) >= 0 and counts.max() - counts.min() <= 1
    placed = sharding.place(odd.withColumn("slot", F.lit("clash")), "doc_id", names, 251)
    assert placed.count() == odd.count() and placed.filter("shard IS NULL").count() == 0
    moved = sharding.moved(spark.range(3000), "id", names, names[:-1], 251).first()
    assert moved.n_rows == 3000 and moved.n_moved < 3000 * 0.35
    assert sharding.place(nothing, "doc_id", names, 251).count() == 0
    with pytest.raises(ValueError):
        sharding.claim_slots(names, 250)


def test_lines(spark, nothing):
    long = " ".join(words(21, 700))
    letters = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    rows = [(1, f"{letters}\nown line of the first one here\n\n---"), (2, f"{letters.upper()}!\nanother line that is not like it"), (3, None), (4, ""), (5, "---\n---"), (6, long), (7, f"x\n{long}"), (8, letters.replace("sigma", "sigmas"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.deduplicated(df).collect()}
    assert got[1] == (rows[0][1], 4, 0) and got[2] == ("another line that is not like it", 2, 1)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5] == ("---\n---", 2, 0) and got[6][2] == 0
    assert got[7] == ("x", 2, 1) and got[8][2] == 1 and got[8][0] == ""
    assert lines.deduplicated(nothing).count() == 0


def test_lines_that_differ_in_digits_or_marks(spark):
    row = "total amount of the order due"
    texts = ["Tel: 555-1234\nkg 3", "Tel: 98 76 54 32 10\nkg 12,500.75", "tel 555 1235", f"{row} 1", f"{row} 2", f"{row} 123 456 789 101", "\u0915\u093f \u0915\u0940", "\u0915\u0941 \u0915\u0942", "kg 3\n12 13", "kg 3\n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lines.deduplicated(df).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0, 8: 1, 9: 1}
    assert {r.doc_id: r.text for r in lines.line_deduplicated_documents(df).collect()} == {**{i: texts[i] for i in (0, 1, 3, 5, 6, 7)}, 8: "12 13"}


def test_simhash_counts_bits():
    rng = np.random.default_rng(1)
    for n in (3, 4, 5):
        rows = [rng.integers(0, 1 << 63, 50, dtype=np.uint64) for _ in range(n)]
        for k, got in enumerate(lines.simhash(rows).tolist()):
            bits = [[int(r[k]) >> b & 1 for r in rows] for b in range(64)]
            assert got == sum(1 << b for b, x in enumerate(bits) if 2 * sum(x) > n or 2 * sum(x) == n and x[0])


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (a != b))
    return row[-1]


def test_edit_distances():
    rng = np.random.default_rng(6)
    for _ in range(1500):
        x, y = ("".join(rng.choice(list("ab\u00e9 "), int(rng.integers(0, 14)))) for _ in range(2))
        d = edit_distance(x, y)
        assert [lines.within(x, y, n) for n in range(16)] == [n >= d for n in range(16)], (x, y)


def changed_lines(rng):
    """Pairs of lines of edit similarity 0.8 or more: letters or words changed, put in or left out."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    word = lambda: "".join(rng.choice(letters, int(rng.choice([2, 3, 4, 5, 6, 7, 8, 9]))))
    vocabulary = [word() for _ in range(3000)]
    for size in (3, 4, 6, 10, 20, 40):
        for kind in ("letter", "word", "out", "tenth", "letters"):
            for _ in range(12):
                x = [str(w) for w in rng.choice(vocabulary, size)]
                y, k = list(x), int(rng.integers(0, size))
                if kind == "out":
                    del y[k]
                else:
                    n = 1 if kind in ("letter", "word") else max(1, size // 10 if kind == "tenth" else size // 5)
                    for k in rng.choice(size, n, replace=False):
                        at = int(rng.integers(0, len(y[k])))
                        y[k] = word() if kind in ("word", "tenth") else y[k][:at] + str(rng.choice(letters)) + y[k][at + int(rng.integers(0, 2)) :]
                x, y = " ".join(x), " ".join(y)
                if x != y and edit_distance(x, y) <= 0.2 * max(len(x), len(y)):
                    yield x, y


def test_recall_of_near_lines(spark):
    pairs = list(changed_lines(np.random.default_rng(12)))
    rows = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    cjk = "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u306f\u7a7a\u767d\u3092\u4f7f\u308f\u306a\u3044\u3067\u66f8\u304b\u308c\u307e\u3059"
    rows += [(9000, cjk), (9001, cjk[:-3] + "\u3057\u305f"), (9002, "Copyright Example Corporation"), (9003, "Copyright Example Corporations")]
    got = {r.doc_id: r.n_dropped for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * i + 1] for i in range(len(pairs)))
    assert len(pairs) > 250 and found >= 0.9 * len(pairs) and not any(got[2 * i] for i in range(len(pairs)))
    assert got[9001] == got[9003] == 1 and got[9000] == got[9002] == 0


def test_first_of_equal_lines_stays(spark):
    line = "the same line over and over again"
    rows = [(5, f"{line}\n{line}"), (5, f"{line}\n{line}"), (7, line), (2, f"own words here\n{line}"), (None, "no id but a line of its own"), (9, "No id, but a line of its own!")]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (2, 0), (5, 2), (5, 2), (7, 1), (9, 1)]


def test_outliers(spark, nothing):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{x}" * int(rng.integers(1, 3)) for x in rng.integers(0, 9999, 100)), "a") for i in range(80)]
    rows += [(900, " ".join("###$$$%%%" for _ in range(10)) + " " + " ".join(f"z{i}%%%" for i in range(60)), "a"), (901, None, "a"), (902, "few words", "a"), (903, "a b c d e f g h " * 9, "a"), (904, "lonely " + " ".join(f"q{i}" for i in range(50)), None)]
    got = {r.doc_id: r for r in outliers.quality_verdicts(docs_of(spark, rows).withColumn("kept", F.lit("clash"))).collect()}
    assert all(got[i].kept for i in range(80)) and not got[900].kept and not got[900].base_failed
    assert got[901].base_failed and got[902].base_failed and got[903].base_failed and got[904].kept
    assert (got[903].n_words, got[903].n_repeat_words) == (72, 72) and got[901].n_words == 0
    clashing = docs_of(spark, rows).withColumns({c: F.lit(1) for c in ("m0", "l00", "log_det", "x0", "_j_g0", "d2", "bin")})
    assert {r.doc_id: (r.kept, r.m0) for r in outliers.quality_verdicts(clashing).collect()} == {i: (r.kept, 1) for i, r in got.items()}
    assert outliers.quality_documents(clashing).columns == clashing.columns
    assert outliers.quality_verdicts(nothing).count() == 0
    assert abs(outliers.chi_square(0.05) - 9.4877) < 1e-3


def test_small_groups_are_judged_by_wider_ones(spark):
    rng = np.random.default_rng(19)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9999, 100)) for _ in range(90)]
    rows = [(i, t, "en" if i < 60 else f"l{i}", f"s{i % 30}", None) for i, t in enumerate(texts)]
    junk = " ".join(f"z{i}###$$$%%%" for i in range(60))
    rows += [(900, junk, "en", "s1", None), (901, junk, "l70", "s10", None), (902, junk, None, None, None)]
    for kept in (rows, rows[80:]):  # two texts in each group, and thirteen in all
        got = {r.doc_id: r for r in outliers.quality_verdicts(spark.createDataFrame(kept, DOCS)).collect()}
        assert {i for i, r in got.items() if not r.kept} == {900, 901, 902}
        assert all(r.distance2 is not None for r in got.values())


def test_passages(spark, odd, nothing):
    got = {(r.doc_id): (r.start_word, r.n_words, r.class_id) for r in passages.passages(odd).filter("doc_id IN (6, 7)").collect()}
    assert got[6][0] <= 80 and got[6][0] + got[6][1] >= 140 and got[7][0] <= 90 and got[7][0] + got[7][1] >= 150
    assert got[6][2] == got[7][2] and got[6][1] < 80
    whole = {r.doc_id for r in passages.passages(odd).collect()}
    assert {0, 1, 2} <= whole and not whole & {3, 4, 5, 8, 9, 10}
    assert passages.passages(nothing).count() == 0


def edited(rng, body, n, kind):
    out = list(body)
    for k in sorted(rng.choice(np.arange(6, len(body) - 6), n, replace=False), reverse=True):
        if kind == "in":
            out.insert(k, f"new{k}")
        elif kind == "out":
            del out[k]
        else:
            out[k] = f"new{k}"
    return out


def test_passages_with_words_put_in_and_left_out():
    rng = np.random.default_rng(8)
    for size, most in ((60, 1), (80, 1), (200, 4), (400, 9)):
        for kind in ("in", "out", "changed"):
            for n in range(1, 3 * most + 1):
                body = [f"b{i}" for i in range(size)]
                near = edited(rng, body, n, kind)
                a, b = (passages._sequences([" ".join(t)])[0] for t in (body, near))
                common = len(np.intersect1d(a, b))
                long = max(len(body), len(near))
                x, y = ([f"{c}{i}" for i in range(40)] + t + [f"{c}{c}{i}" for i in range(40)] for c, t in (("p", body), ("q", near)))
                rows = passages._sequences([" ".join(x), " ".join(y)])
                found = passages.stretches(*rows, [0])
                if common >= 0.8 * (len(a) + len(b) - common) and min(len(a), len(b)) >= passages.SPAN:
                    assert any(xs <= 46 and xe >= 40 + len(a) - 6 and ys <= 46 and ye >= 40 + len(b) - 6 for xs, xe, ys, ye in found), (size, kind, n)
                for xs, xe, ys, ye in found:
                    assert min(xe - xs, ye - ys) >= passages.SPAN and max(xe - xs, ye - ys) <= long + 80
    p, q = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(70)]
    rows = passages._sequences([" ".join([*p, *q]), " ".join([*q, *p])])
    assert passages.stretches(*rows, [0]) == [(0, 56, 70, 126), (60, 126, 0, 66)]


def test_passages_link_all_pairs_of_a_key(spark):
    rng = np.random.default_rng(15)
    rows = []
    for f in range(60):  # x ~ y ~ z ~ u, but x isn't near z or u, nor y near u
        text = [f"f{f}w{i}" for i in range(60)]
        for i, k in enumerate((None, 30, 10, 50)):
            text = [f"f{f}new{k}" if j == k else w for j, w in enumerate(text)]
            rows.append((f * 4 + i, " ".join(text), "a"))
    ids = rng.permutation(len(rows))
    df = docs_of(spark, [(int(ids[i]), t, s) for i, t, s in rows])
    of_key, sets, root = {}, {i: h for i, h in zip((int(ids[i]) for i, _, _ in rows), passages._sequences([t for _, t, _ in rows]), strict=True)}, {}
    for r in passages._places(passages._windows(df)).collect():
        of_key.setdefault(r.key, []).append((r.doc_id, r.c))
    for group in of_key.values():
        for x, c in group:
            for y, d in group:
                if x < y and passages.stretches(sets[x], sets[y], [d - c]):
                    a, b = root.get(x, x), root.get(y, y)
                    members = {x, y} | {k for k, v in root.items() if v in (a, b)}
                    root.update(dict.fromkeys(members, min(a, b)))
    got = {}
    for r in passages.passages(df).collect():
        got.setdefault(r.class_id, set()).add(r.doc_id)
    want = {}
    for k, v in root.items():
        want.setdefault(v, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and max(map(len, want.values())) == 4


def test_places_are_all_common_beginnings():
    rng = np.random.default_rng(4)
    doc, key, packed, want = [], [], [], []
    for d in range(5):
        spans = []
        for f in range(passages.HASHES):
            at = int(rng.integers(0, 30))
            for k in range(int(rng.integers(0, 9))):
                lo = at
                hi = lo + int(rng.integers(0, passages.SPAN))
                c, at = int(rng.integers(hi, lo + passages.SPAN)), hi + 1 + int(rng.integers(0, 20))
                spans.append((f, c, lo, hi))
                doc, key = [*doc, d], [*key, f * 1000 + k]
                packed.append(((c * passages.SPAN + c - lo) * passages.SPAN + c - hi) * passages.HASHES + f)
        want += [(d, c, max(lo, lo2), min(hi, hi2)) for f, c, lo, hi in spans for f2, _, lo2, hi2 in spans if f < f2 and max(lo, lo2) <= min(hi, hi2)]
    got = passages._met(*(np.array(x, np.int64) for x in (doc, key, packed)))
    assert sorted(zip(*[v.tolist() for v in got[1:]], strict=True)) == sorted(want)


def test_passages_of_repeated_ids(spark):
    shared = " ".join(f"s{i}" for i in range(80))
    rows = [(1, shared, "a"), (1, shared, "b"), (1, "another text " + shared, "a"), (2, "x y z " + shared + " end", "a"), (None, shared, "a"), (3, None, "a")]
    got = passages.passages(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2] and len({r.class_id for r in got}) == 1 and all(78 <= r.n_words <= 84 for r in got)


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(100):
        h, span = rng.integers(0, int(rng.integers(2, 500)), int(rng.integers(1, 60))).astype(np.uint64), int(rng.integers(1, 12))
        want = []
        for c in range(len(h)):
            left = right = c
            while left > 0 and h[left - 1] > h[c]:
                left -= 1
            while right < len(h) - 1 and h[right + 1] >= h[c]:
                right += 1
            if right - left + 1 >= span:
                want.append((left, c, right))
        assert list(zip(*[x.tolist() for x in passages.compact_windows(h, span)], strict=True)) == want


def test_mixing(spark, nothing):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), s) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 3000), rng.choice(["a", "b", "c", "d"], 3000, p=[0.7, 0.1, 0.15, 0.05]), strict=True))]
    rows += [(9000, None, None), (9001, "x y", None), (9002, "x y", "a"), (9002, "x y", "a")]
    df = docs_of(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in got)
    totals = {}
    for i, t, s in rows:
        totals[s] = totals.get(s, 0) + len((t or "").split())
    order = [s for s in sorted(totals, key=lambda s: (s is None, s or ""))]
    weight, cap = {s: 1 + k % 3 for k, s in enumerate(order)}, {s: 3 * totals[s] for s in order}
    want, free, left = {}, set(order), sum(totals.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap[s]}
        if not over:
            want |= share
            break
        want |= {s: cap[s] for s in over}
        left, free = left - sum(cap[s] for s in over), free - over
    of = dict((i, s) for i, _, s in rows)
    taken = {s: sum(r.taken for r in got if of[r.doc_id] == s) for s in order}
    for r in got:
        assert abs(r.target - want[of[r.doc_id]]) < 1e-6 * max(1, r.target) and r.source_size == totals[of[r.doc_id]]
    assert all(abs(taken[s] - want[s]) <= 60 for s in order)
    again = sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(nothing).count() == 0


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(800)]
    rows, marks = [], []
    for i in range(600):
        text, y = list(rng.choice(vocabulary, 60)), int(i % 4 == 0)
        for k in rng.integers(0, 60, 3) if y else ():
            text[k] = rng.choice(["grumbolux", "grumbolus", "grumbolix"])
        rows.append((i, " ".join(text), "a"))
        marks.append((i, y, 1))
    rows += [(900, None, "a"), (901, "", "a"), (902, " ".join(rng.choice(vocabulary, 30)) + " grumbolaz grumboluz " + " ".join(rng.choice(vocabulary, 20)), "a")]
    docs, labels = docs_of(spark, rows).withColumn("score", F.lit("clash")), spark.createDataFrame([*marks, (902, None, 1)], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    held = [(got[i].predicted, y) for i, y, _ in marks if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.95 and got[902].predicted == 1
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 for r in got.values())
    assert got[3].held_out == (zlib.crc32(b"3") % 4 == 2)
    assert toxicity.score(nothing, toxicity.train([], np.zeros(0))).count() == 0
