"""Fuzzy line dedup.

Lines are normalised: lower case, letters with their marks and digits only, single spaces. Equal ones are one class. A
line's features are its words, a short word together with the one before it; letters of scripts without spaces are words.
Features lie on a ring by their hash, and the ring is cut at fixed points. A line's signature has a block for each cut:
the SimHash (bit by bit what most hashes have) of the few features that follow. An edit changes the few blocks whose
features it touches, so by the pigeonhole principle near lines agree in others, on which they are joined. Short lines have
blocks of three words, from every feature on, and of letter triples too. One SimHash of a whole line, cut into blocks,
has no such blocks: a changed word in ten moves bits of nearly all of them.

Signatures and edit distances are DataFrame functions. Lines that meet are verified by edit similarity. Of each connected group one occurrence stays, the first by doc_id and line.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, dropped, small_join, stored
from .graph import components

SIMILARITY = 0.8
#: Words and letter triples of a block, and cuts of the ring.
BLOCKS, CUTS = (4, 5), 16
#: Lines of at most WHOLE features have blocks of LEAST, from every feature on.
WHOLE, LEAST = 14, 3
#: Features in a sketch, about, and the share of the bits of two sketches, beside BITS more, that may differ.
SKETCHED, DIFFER, BITS = 24, 0.35, 4
#: Lines of at most so many characters have blocks of letter triples too.
LETTERS_TO = 60
#: A word of at most so many bytes counts together with the one before it.
SHORT_WORD = 3
#: Rounds in which the classes of a key are held against one of them, before all that aren't of one group meet: first against
#: the one of all their keys' with which they share most keys, then against the others.
ROUNDS = 3
#: Rows of a key, and characters of their lines, of a block in which the last round holds the lines of large keys.
BLOCK, BLOCK_CHARS = 64, 1 << 20
#: Letters of Thai, Lao, Tibetan, Myanmar, Khmer, Hiragana, Katakana and Han, which have no spaces.
_UNSPACED = r"[\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{1B000}-\x{1B16F}\x{20000}-\x{323AF}]"


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " "))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def _ring(hashes: Column) -> Column:
    return F.sort_array(F.array_distinct(hashes))


def word_features(norm: Column) -> Column:
    """The sorted different hashes of the words of a normalised line; a short one's together with the word before it."""
    apart = F.array_remove(F.split(F.regexp_replace(norm, _UNSPACED, " $0 "), " "), "")
    words = F.when(F.octet_length(norm) == F.char_length(norm), F.split(norm, " ")).otherwise(apart)
    hashed = lambda ws: lambda w, i: F.xxhash64(w, F.when(F.octet_length(w) <= SHORT_WORD, F.get(ws, i - 1)))
    return _ring(_once(words, lambda ws: F.transform(ws, hashed(ws))))


def letter_features(norm: Column) -> Column:
    """The sorted different hashes of each three characters in a row of a normalised line, with a space at both ends."""
    triple = lambda t: lambda i: F.xxhash64(F.lit(3), F.substring(t, i, F.lit(3)))
    at = F.sequence(F.lit(1), F.greatest(F.char_length(norm), F.lit(1)))
    return _ring(_once(F.concat(F.lit(" "), norm, F.lit(" ")), lambda t: F.transform(at, triple(t))))


def simhash(hashes: list, both: Callable = np.bitwise_and, either: Callable = np.bitwise_or, one: Callable = np.bitwise_xor):  # noqa: ANN201
    """Of three to five hashes, each bit as most have it; as the first has it, where two have it and two don't. Arrays by
    themselves; Columns with their bitwise and, or and exclusive or."""
    most = lambda a, b, c: either(both(a, either(b, c)), both(b, c))
    if len(hashes) == 3:
        return most(*hashes)
    a, b, c, d, e = hashes if len(hashes) == 5 else [hashes[0], *hashes]
    odd = one(one(a, b), c)
    pairs, more = most(a, b, c), most(odd, d, e)
    return either(both(pairs, more), both(either(pairs, more), one(odd, one(d, e))))


def _sketch(ring: Column, level: Column) -> Column:
    """64 bits, of which each feature sets one; of many features, only those with level zeros in a row count, so that about
    SKETCHED are left."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    mask = F.call_function("shiftleft", F.lit(64).cast("long"), level) - 64
    return _once(mask, lambda m: F.aggregate(ring, F.lit(0).cast("long"), lambda s, x: F.when(x.bitwiseAND(m) == 0, s.bitwiseOR(bit(x))).otherwise(s)))


def _blocks(ring: Column, block: int) -> Column:
    """The SimHash of ``block`` features of the ring in a row, from the first after each cut on; if they are few, of LEAST
    from each one on. Of still fewer features, the hash of all."""
    n, bits = F.size(ring), 64 - (CUTS.bit_length() - 1)
    of = lambda on, k: lambda x, i: simhash([x, *[F.get(on, i + j) for j in range(1, k)]], Column.bitwiseAND, Column.bitwiseOR, Column.bitwiseXOR)
    cut = lambda on, x, i: (i == 0) | (F.shiftright(x, bits) != F.shiftright(F.get(on, i - 1), bits))
    many = lambda on: F.filter(F.transform(ring, lambda x, i: F.when(cut(on, x, i), of(on, block)(x, i))), F.isnotnull)
    some = lambda on: F.transform(ring, of(on, LEAST))
    return _once(F.concat(ring, ring), lambda on: F.when(n > WHOLE, many(on)).when(n >= LEAST, some(on)).otherwise(F.array(F.xxhash64(ring))))


def with_keys(classes: DataFrame) -> DataFrame:
    """id, len, sketch, level, keys (array of longs) for each class (id, norm): its length in characters and its blocks."""
    norm = F.col("norm")
    rows = classes.select("id", F.char_length(norm).alias("len"), word_features(norm).alias("ring"), F.when(F.char_length(norm) <= LETTERS_TO, letter_features(norm)).alias("letters"))
    rows = rows.withColumn("level", F.greatest(F.floor(F.log2(F.greatest(F.size("ring"), F.lit(1)) / SKETCHED)), F.lit(0)).cast("int"))
    keys = F.concat(_blocks(F.col("ring"), BLOCKS[0]), F.when(F.col("letters").isNull(), F.array().cast("array<long>")).otherwise(_blocks(F.col("letters"), BLOCKS[1])))
    return rows.select("id", "len", _sketch(F.col("ring"), F.col("level")).alias("sketch"), "level", F.array_distinct(keys).alias("keys"))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, h1, h2 (of the normalised line), and norm, for each line with a letter."""
    lines = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")
    )
    lines = lines.filter(F.col("line").rlike(r"\p{L}")).select("doc_id", "text_hash", "line_no", normalised(F.col("line")).alias("norm"))
    return lines.withColumns({"h1": F.xxhash64("norm"), "h2": F.xxhash64(F.lit(1), "norm")})


def _same(x: str, y: str) -> int:
    """How many characters two texts begin with alike."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
    return low


def _alike(x: str, i: int, y: str, j: int) -> int:
    """How many characters from i on in x and from j on in y are alike; takes steps in proportion to the number's logarithm."""
    n, step, most = 0, 16, min(len(x) - i, len(y) - j)
    while n + step <= most and x[i + n : i + n + step] == y[j + n : j + n + step]:
        n, step = n + step, 2 * step
    while step:
        if n + step <= most and x[i + n : i + n + step] == y[j + n : j + n + step]:
            n += step
        step //= 2
    return n


def _edits(x: str, y: str, most: int) -> int:
    """The length of one way of edits from x to y, so no less than their distance; more than ``most`` where it isn't finished,
    as it is too long or takes many steps for the way it has come.

    Where they differ, a letter or the rest of a word is put for another, or a letter or a word left out or put in,
    whichever lets most follow alike.
    """
    i = j = cost = steps = 0
    while cost <= most and steps <= 3 + (i + j) // 50:
        n = _alike(x, i, y, j)
        i, j = i + n, j + n
        if i == len(x) or j == len(y):
            return cost + len(x) - i + len(y) - j
        a, b = (t.find(" ", k) % (len(t) + 1) for t, k in ((x, i), (y, j)))
        long_x, long_y = a - x.rfind(" ", 0, i), b - y.rfind(" ", 0, j)
        ways = (1, 1), (a - i, b - j), (1, 0), (0, 1), (min(long_x, len(x) - i), 0), (0, min(long_y, len(y) - j))
        p, q = max(ways, key=lambda way: _alike(x, i + way[0], y, j + way[1]) - max(way))
        i, j, cost, steps = i + p, j + q, cost + max(p, q), steps + 1
    return most + 1


def within(x: str, y: str, most: int) -> bool:
    """Whether the edit distance of x and y is at most ``most``. A way of edits that is short enough proves it; else a
    column of the distance table is two long numbers whose bits say where it rises and falls by one."""
    k = _same(x, y)
    x, y = x[k:], y[k:]
    k = _same(x[::-1], y[::-1])
    x, y = sorted((x[: len(x) - k], y[: len(y) - k]), key=len)
    if len(y) - len(x) > most:
        return False
    if len(y) <= most or not x:
        return len(y) <= most
    if _edits(x, y, most) <= most:
        return True
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(x)) - 1, 1 << len(x) - 1
    up, down, score = full, 0, len(x)
    for left, c in zip(range(len(y) - 1, -1, -1), y, strict=True):
        eq = where.get(c, 0)
        low = eq | down
        eq = ((eq & up) + up ^ up) | eq
        rise, fall = down | full & ~(eq | up), up & eq
        if rise & top:
            score += 1
            if score - left > most:
                return False
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 & full | 1, fall << 1 & full
        up, down = fall | full & ~(low | rise), rise & low
    return score <= most


def _near(x: Column, y: Column, most: Column) -> Column:
    """Whether the edit distance of two different lines, given as their words, is at most ``most``. Words that both begin or
    end with are left out, as they don't change it; each word left has a space after it, so that one that is only in one
    of them counts with its space. Edits of word after word, from the front or the back, that are few enough prove it, in
    time that grows with the length alone; else the distance is counted."""
    edits = lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(F.coalesce(F.levenshtein(a, b), F.char_length(F.coalesce(a, b)) + 1))
    by_word = lambda u, v: F.aggregate(F.zip_with(u, v, edits), F.lit(0), lambda n, k: n + k) <= most
    unlike = lambda u, v: F.array_position(F.zip_with(u, v, lambda a, b: a.eqNullSafe(b)), False).cast("int")
    back = lambda w, p: F.reverse(F.slice(w, p, 1 << 30))
    left = lambda w, p, q: F.array_join(F.concat(F.slice(w, p, F.size(w) - p - q + 2), F.array(F.lit(""))), " ")
    distance = lambda p, q: F.call_function("levenshtein", left(x, p, q), left(y, p, q), most)  # noqa: E731  -1 beyond most
    counted = _once(unlike(x, y), lambda p: _once(unlike(back(x, p), back(y, p)), lambda q: distance(p, q) >= 0))
    return by_word(x, y) | by_word(F.reverse(x), F.reverse(y)) | counted


def _most(x: Column, y: Column) -> Column:
    """The edits that two lines of so many characters may differ by."""
    return F.floor(F.greatest(x, y) * (1 - SIMILARITY) + 1e-9).cast("int")


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, linked: linked if the edit distance is at most (1 - SIMILARITY) of the longer line's length."""
    needed = stored(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"))
    texts = stored(small_join(classes.select("id", "norm"), needed, "id", "left_semi"))
    of = lambda c, name: texts.select(F.col("id").alias(c), F.col("norm").alias(name))
    # few bytes are much work, so the number of tasks doesn't go by bytes
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = pairs.join(of("a", "x"), "a").repartition(tasks, "b").join(of("b", "y").repartition(tasks, "b"), "b")
    split = joined.select("a", "b", _most(F.char_length("x"), F.char_length("y")).alias("most"), F.split("x", " ").alias("x"), F.split("y", " ").alias("y"))
    held = stored(split.select("a", "b", _near(F.col("x"), F.col("y"), F.col("most")).alias("linked")))
    dropped(needed, texts)
    return held


def _allowed(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether the lengths and sketches of two rows, named by a and b, let them be near."""
    lengths = 100 * F.least(a("len"), b("len")) >= round(100 * SIMILARITY) * F.greatest(a("len"), b("len"))
    most = DIFFER * (F.bit_count(a("sketch")) + F.bit_count(b("sketch"))) + BITS
    return lengths & ((a("level") != b("level")) | (F.bit_count(a("sketch").bitwiseXOR(b("sketch"))) <= most))


def _linked_in_blocks(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: all links between rows (key, id, len, sketch, level, component, n, chars) of one key and two components.

    A key's n rows of so many chars are dealt to blocks, and each two blocks, or one with itself, are one row, in which
    the lines are held against each other; a pair in the least key that both have.
    """
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("chars") / BLOCK_CHARS)).cast("int")
    keys = stored(rows.groupBy("id").agg(F.collect_set("key").alias("keys")))
    texts = stored(small_join(classes.select("id", "norm"), keys.select("id"), "id", "left_semi").join(keys, "id"))
    dealt = rows.select("key", "id", "len", "sketch", "level", "component", parts.alias("parts"), F.pmod(F.xxhash64("id", F.lit(1)), parts).cast("int").alias("part"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("key", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "part", "id", "len", "sketch", "level", "component")
    tasks, on = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["key", "one", "two"]
    about = ("part", "id", "len", "sketch", "level", "component", "keys", "norm")
    blocks = dealt.join(texts, "id").repartition(tasks, *on).groupBy(*on).agg(F.collect_list(F.struct(*about)).alias("rows"))
    lines = F.transform("rows", lambda r: r.withField("words", F.split(r["norm"], " ")).dropFields("norm"))
    of = lambda part: F.filter("rows", lambda r: r["part"] == F.col(part))
    sides = blocks.select(*on, lines.alias("rows")).select(*on, of("one").alias("left"), of("two").alias("right"))
    fresh = lambda x, y: (x["component"] != y["component"]) & ((F.col("one") < F.col("two")) | (x["id"] < y["id"])) & _allowed(x.getField, y.getField)
    least = lambda x, y: F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("key")
    linked = lambda x, y: fresh(x, y) & least(x, y) & _near(x["words"], y["words"], _most(x["len"], y["len"]))
    found = F.transform("left", lambda x: F.transform(F.filter("right", lambda y: linked(x, y)), lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"))))
    links = stored(sides.select(F.explode(F.flatten(found)).alias("link")).select("link.a", "link.b"))
    dropped(keys, texts)
    return links


def _placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (key, id, ..) with the component of groups (id, component) that their id is in, or itself."""
    return small_join(rows, groups, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _joined(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """groups (id, component) with those joined that links (a, b) connect: only links between components are followed, as
    links of these, so those inside one are never labelled again."""
    if groups is None:
        return components(links).select(F.col("node").alias("id"), "component")
    of = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    across = small_join(small_join(links, of("a"), "a", "left"), of("b"), "b", "left")
    across = across.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).filter("a <> b").distinct()
    moved = components(stored(across))
    every = groups.union(moved.select("node", "node")).distinct()
    moved = moved.select(F.col("node").alias("component"), F.col("component").alias("now"))
    return stored(small_join(every, moved, "component", "left").select("id", F.coalesce("now", "component").alias("component")))


def near_lines(classes: DataFrame) -> DataFrame:
    """id, component: the groups of classes (id, norm) that links connect: all that meet in a key and have SIMILARITY.

    Each class is held against one of the least ones of its keys, then, where they aren't of one group yet, against the
    other ones, against another one of each key, and at last all against all of other groups, so no pair that shares a
    key is left out. Keys that then have more than BLOCK rows are held in blocks.
    """
    signed = stored(with_keys(classes))
    keys = signed.select("id", "len", "sketch", "level", F.explode("keys").alias("key"))
    leaders = stored(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    rows = stored(small_join(keys, leaders, "key", "left_semi"))
    dropped(signed, leaders)
    allowed = _allowed(*[lambda name, s=s: F.col(f"{name}_{s}") for s in "ab"])
    about = ("id", "len", "sketch", "level", "component")
    held, groups = None, None
    for turn in range(ROUNDS + 1):
        open_rows = rows.withColumn("component", F.col("id")) if groups is None else _placed(rows, groups)
        if groups is not None or turn == ROUNDS:
            mixed = open_rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("len").alias("chars"))
            mixed = stored(mixed.filter("lo < hi").select("key", "n", "chars"))
            open_rows = stored(small_join(open_rows, mixed, "key"))
            dropped(rows, mixed)
            rows = open_rows.drop("component", "n", "chars")
        few = open_rows if turn < ROUNDS else open_rows.filter(F.col("n") <= BLOCK)
        left, right = (few.select("key", *[F.col(c).alias(f"{c}_{s}") for c in about]) for s in "ab")
        if turn < ROUNDS:
            order = F.xxhash64("id_a", F.lit(turn)) if turn > 1 else F.col("id_a")
            left = left.groupBy("key").agg(F.min_by(F.struct(*[f"{c}_a" for c in about]), order).alias("x")).select("key", "x.*")
        met = left.join(right, (left.key == right.key) & (F.col("component_a") != F.col("component_b")) & allowed)
        if turn == ROUNDS:
            met = met.filter("id_a < id_b")
            if not (large := open_rows.filter(F.col("n") > BLOCK)).isEmpty():
                groups = _joined(groups, _linked_in_blocks(large, classes))
        if turn == 0:
            shared = met.groupBy("id_a", "id_b").agg(F.count("*").alias("n"))
            met = shared.groupBy("id_b").agg(F.min_by("id_a", F.struct(-F.col("n"), "id_a")).alias("id_a"))
        pairs = met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
        pairs = stored(pairs if held is None else pairs.join(held.select("a", "b"), ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        now = _verified(pairs, classes)
        held = now if held is None else held.unionByName(now)
        groups = _joined(groups, now.filter("linked").select("a", "b"))
    dropped(rows)
    if groups is None:
        return classes.select("id", F.col("id").alias("component")).filter("false")
    return groups


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no of each line to drop from docs (doc_id, text)."""
    every = stored(_lines(docs))
    grouped = every.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "text_hash", "line_no")).alias("first"), F.count("*").alias("n"), F.first("norm").alias("norm")
    )
    classes = stored(grouped.withColumn("id", F.monotonically_increasing_id()))
    lines = stored(every.drop("norm"))
    dropped(every)
    part = near_lines(classes)
    narrow = classes.select("id", "h1", "h2", "first", "n")
    placed = small_join(narrow, part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    kept = placed.groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("total")).filter("total > 1")
    repeated = stored(placed.join(kept, "component").select("h1", "h2", "keep"))
    dropped(classes)
    rows = small_join(lines, repeated, ["h1", "h2"])
    return rows.filter(~F.struct("doc_id", "text_hash", "line_no").eqNullSafe(F.col("keep"))).select("doc_id", "text_hash", "line_no")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines taken out of text; n_lines and n_dropped (long) are added.

    A null or empty text stays as it is, as do lines without letters. Rows that repeat both doc_id and text count as one
    and are cut alike; of equal lines in one text the first stays, and a null id comes before all others. Other columns
    are carried as they are; columns of docs named n_lines or n_dropped are replaced. An empty table stays empty.
    """
    drop = duplicate_lines(docs).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("_drop"))
    drop = stored(drop.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_drop"))
    rows = docs.drop("n_lines", "n_dropped")
    names = rows.columns
    rows = small_join(rows, drop, rows.doc_id.eqNullSafe(drop._id) & (F.xxhash64("text") == drop._hash), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains("_drop", i))
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in names],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_deduplicated_documents(docs: DataFrame) -> DataFrame:
    """The columns of docs; documents that lose lines and have none left but blank ones are left out.

    Null and empty texts stay, as do repeated rows, alike; an empty table stays empty.
    """
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(WORD)
    return deduplicated(docs).filter(left).select(*docs.columns)
