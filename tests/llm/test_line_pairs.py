"""Which lines are held against each other, and how often."""

from millrace.llm import lines


def test_each_line_of_a_group_is_verified_once(spark, monkeypatch):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()
    rows = [(i, " ".join(words[:i] + [f"x{i}y"] + words[i + 1 :])) for i in range(len(words))]
    held, verify = [], lines._verified
    monkeypatch.setattr(lines, "_verified", lambda pairs, classes: held.append(pairs.count()) or verify(pairs, classes))
    groups = lines.near_lines(spark.createDataFrame(rows, "id long, norm string")).collect()
    assert {(r.id, r.component) for r in groups} == {(i, 0) for i, _ in rows}
    assert held[0] < len(rows) and sum(held) <= 2 * len(rows)


def test_lines_are_normalised_once(spark, monkeypatch):
    seen, normalise = [], lines.normalised
    monkeypatch.setattr(lines, "normalised", lambda line: seen.append(1) or normalise(line))
    docs = spark.createDataFrame([(1, "One line here\nof two"), (2, "one line, here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.deduplicated(docs).collect()}
    assert got == {1: ("One line here\nof two", 2, 0), 2: ("", 1, 1), 3: (None, 0, 0)}
    assert len(seen) == 1
