import random

from pyspark.sql import functions as F

from packetloom.llm import line_dedup as ld


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b


def brute(rows, min_chars):
    lines = [((i, no), r, no, x) for r, (i, t) in enumerate(rows) for no, x in enumerate((t or "").split("\n")) if len(x) >= min_chars and x.strip(" \t\n\r\x0b\x0c")]
    gone = {(r, no) for at, r, no, x in lines if any(b < at and near(x, y) for b, _, _, y in lines)}
    return [None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (r, no) not in gone) for r, (_, t) in enumerate(rows)]


def test_dedup(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abé \U0001f600") for _ in range(r.randrange(6, 30))) for _ in range(25)] + ["aaaaaaaaaa", "abababababab"]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randrange(6)):
            x = r.choice(base)
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                p = r.randrange(len(x) + 1)
                x = r.choice((x[:p] + r.choice("abé") + x[p:], x[:p] + x[p + 1 :], x[:p] + r.choice("ab") + x[p + 1 :]))
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    rows += [(90, None), (91, ""), (92, "\n\n" + " " * 40 + "\nshort"), (93, "x" * 30), (94, "x" * 31), (95, "x" * 32 + "\r")]
    df = spark.createDataFrame([(*x, 5, "k") for x in rows], "doc_id long, text string, doc int, drop string").repartition(3)
    got = {x.doc_id: x for x in ld.dedup(df, 8).collect()}
    want = brute(rows, 8)
    assert {i: x.text for i, x in got.items()} == {i: t for (i, _), t in zip(rows, want)}
    assert all(x.doc == 5 and x.drop == "k" for x in got.values())
    assert got[92]._n_lines == 1 and got[90]._n_lines == 0


def test_native_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup(none).count() == 0
    df = spark.createDataFrame([(None, "the very same line of text"), (3, "the very same line of text"), (4, "the very same line of texts")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in ld.dedup(df).collect()} == {None: "the very same line of text", 3: "", 4: ""}
    plan = ld.dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    repeated = df.union(df.where("doc_id is null"))
    assert repeated.count() == ld.dedup(repeated).count() and F is not None


def test_short_lines_that_repeat(spark):
    rows = [(1, "And ornd.\nA first line that is long enough\n \nx"), (2, "And ornd.\nAnd orns.\n \nx\nAnd ornd."), (3, "A first line that is long enoug\nAnd orns.")]
    got = {x.doc_id: (x.text, x._n_removed) for x in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # equal ones go at every length, near ones only from MIN_CHARS on
    assert got == {1: (rows[0][1], 0), 2: ("And orns.\n ", 3), 3: ("", 2)}


def test_long_lines(spark):
    # memory and time in proportion to the line; the edit in any block, at both ends, or none
    r = random.Random(2)
    base = "".join(r.choice("abcdé fg") for _ in range(120_000))
    edits = [base, base[1:], base[:-1], base[:70_000] + "X" + base[70_001:], base[:511] + base[512:], base + "y", base[:60_000] + "é" + base[60_000:], base[:9] + "Q" + base[10:90_000] + "Q" + base[90_001:]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(edits)], "doc_id long, text string")
    got = {x.doc_id: x._n_removed for x in ld.dedup(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0}


def test_blocks_of_mixed_lengths(spark):
    # lengths around the border between the two ways to make keys
    r = random.Random(4)
    limit = ld.FINE_BLOCKS * ld.BLOCK_CHARS
    rows = []
    for n in (limit - 1, limit, limit + 1, limit + 2):
        x = "".join(r.choice("abc") for _ in range(n))
        p = r.randrange(n)
        for y in (x, x[:p] + "d" + x[p:], x[:p] + x[p + 1 :], x[:p] + "d" + x[p + 1 :], x[:p] + "d" + x[p + 1 : -3] + "d" + x[-2:]):
            rows.append((len(rows), y))
    got = {x.doc_id: x.text for x in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert list(map(got.get, range(len(rows)))) == brute(rows, ld.MIN_CHARS)


def test_many_lines_go(spark):
    lines = [f"line number {i // 2} of a long text" + "x" * (i // 2 % 7) for i in range(4000)]
    rows = [(-3, "\n".join(lines)), (-5, lines[0] + "\n" + lines[8])]
    got = {x.doc_id: x.text for x in ld.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[-3], got[-5]] == brute(rows, ld.MIN_CHARS)


def test_clashing_names(spark):
    names = ["doc", "th", "_doc", "_th", "_drop", "_n_lines", "_N_removed", "a.b", "key", "line"]
    df = spark.createDataFrame([(i, "a line that comes again\nx", *range(10)) for i in range(2)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = ld.dedup(df)
    assert got.columns == [*df.columns, "_n_lines_", "_n_removed_"]
    assert sorted(got.collect()) == [(0, "a line that comes again\nx", *range(10), 2, 0), (1, "", *range(10), 2, 2)]
