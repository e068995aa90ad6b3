"""The bounded edit distance of lines against the whole distance table."""

import random

from millrace.llm.lines import _edits, near_lines, within


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        now = [i]
        for j, d in enumerate(y, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
        row = now
    return row[-1]


def test_within_is_the_edit_distance():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    for _ in range(500):
        one = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        two = list(one)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(two))
            two[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 1)
        x, y = " ".join(one), " ".join(two)
        true = distance(x, y)
        for most in {max(true - 1, 0), true, true + 1, max(len(x), len(y)) // 5}:
            assert within(x, y, most) == (true <= most), (x, y, most)
            assert min(_edits(x, y, most), most + 1) >= min(true, most + 1)


def test_lines_near_each_other_but_not_the_first_of_their_key(spark):
    """The first of a key may be near none of the others, here by length."""
    tail = "alpha bravo charlie delta echo foxtrot"
    rows = [(0, f"{tail} golf hotel india juliett kilo lima mike"), (1, f"{tail} nova"), (2, f"{tail} novas")]
    groups = near_lines(spark.createDataFrame(rows, "id long, norm string"))
    assert {(r.id, r.component) for r in groups.collect()} == {(1, 1), (2, 1)}
