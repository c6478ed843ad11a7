"""Line dedup against brute force."""

from __future__ import annotations

import random
import time

from paperlake.llm import line_dedup as L


def model(rows, k=L.K, w=L.W):
    """Line numbers that may go: covered by a run of k lines, or a line or gram of over LONG words, that occurs earlier;
    and those that must: in runs of k + w - 1, or passages of over LONG words, that occur earlier."""
    first, may, must = set(), set(), set()
    for d, t in sorted(rows):
        lines = t.split("\n") if t else []
        for n in sorted({1, k, k + w - 1}):
            for i in range(len(lines) - n + 1):
                g = (n, *lines[i : i + n])
                covered = {(d, j) for j in range(i, i + n)}
                if g in first:
                    long = len(" ".join(g[1:]).split()) > L.LONG
                    if n >= k or long:
                        may |= covered
                    if n == k + w - 1 or (long and n <= k):
                        must |= covered
                first.add(g)
    return may, must


def gone(spark, df):
    """(document, line) of all lines to delete."""
    keys = df.select("doc_id", L.row_key("doc_id", "text").alias("key"))
    return {(r.doc_id, j) for r in L.repeated_runs(df, "doc_id", "text").join(keys, "key").collect() for j in range(r.a, r.b + 1)}


def corpus():
    rng = random.Random(8)
    lines = ["line %d" % i for i in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) + str(rng.randrange(3)) for _ in range(rng.randint(1, 30)))) for i in range(30)]
    block = ["shared %d" % i for i in range(8)]
    for i in range(30, 60):
        own = ["own %d %d" % (i, j) for j in range(rng.randint(0, 5))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + block[rng.randint(0, 2) : rng.randint(6, 8)] + own[at:])))
    rows += [(60, rows[3][1]), (61, "a\na\na\na\na"), (62, "one line"), (63, "one line")]
    return rows


def test_deletes_what_must_go_and_nothing_else(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    may, must = model(rows)
    went = gone(spark, df)
    assert must <= went <= may and len(must) > 100
    out = {r.doc_id: r.text for r in L.dedup_lines(df).collect()}
    for d, t in rows:
        left = [x for j, x in enumerate(t.split("\n")) if (d, j) not in went]
        assert out[d] == "\n".join(left), d
    assert out[60] == "" and out[62] == out[63] == "one line"
    by = {r.doc_id: r for r in L.digest(df).collect()}
    for d, t in rows:
        assert by[d].n_lines == len(t.split("\n")) and by[d].n_removed == sum(x == d for x, _ in went)


def test_long_texts_take_linear_time(spark):
    """60,000 lines over few distinct ones, and two copies of many lines: seconds, not minutes."""
    rng = random.Random(2)
    few = "\n".join(str(rng.randrange(8)) for _ in range(60_000))
    many = "\n".join(f"line {j}" for j in range(60_000))
    began = time.monotonic()
    by = {r.doc_id: r for r in L.digest(spark.createDataFrame([(1, few), (2, many), (3, many), (4, "a\n" * 60_000)], "doc_id long, text string")).collect()}
    assert by[1].n_removed > 59_000 and by[2].n_removed == 0 and by[3].n_removed == 60_000 and by[4].n_removed > 59_000
    assert time.monotonic() - began < 90


def test_native_plan(spark):
    import io
    from contextlib import redirect_stdout

    f = io.StringIO()
    with redirect_stdout(f):
        L.digest(spark.createDataFrame(corpus(), "doc_id long, text string")).explain()
    assert "Python" not in f.getvalue() and "Arrow" not in f.getvalue().replace("ArrowSchema", "")


def test_odd_rows(spark, odd_docs, no_docs):
    rows = L.digest(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_lines == by[3].n_lines == 0
    assert (by[6].n_lines, by[6].n_removed) == (8, 4)
    assert L.drop_repeats(odd_docs).columns == odd_docs.columns
    assert L.digest(no_docs).count() == 0


def test_long_passages_always_go(spark):
    rng = random.Random(4)
    long = lambda n, words: " ".join(f"{n}w{j}" for j in range(words))
    pairs = [(long(f"a{n}", 30), long(f"b{n}", 30)) for n in range(12)]
    singles = [long(f"s{n}", 51) for n in range(12)]
    rows, must = [(0, "\n".join([x for p in pairs for x in (*p, "between")] + [x for s in singles for x in (s, "other")])), (1, long("t", 60)), (2, long("t", 60)), (3, long("u", 50)), (4, long("u", 50))], {(2, 0)}
    for d in range(5, 60):
        own = [f"own {d} {j}" for j in range(rng.randint(2, 9))]
        at = rng.randint(0, len(own))
        run = rng.choice(pairs) if d % 2 else (rng.choice(singles),)
        must.update((d, at + j) for j in range(len(run)))
        rows.append((d, "\n".join([*own[:at], *run, *own[at:]])))
    out = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for d, t in rows:
        want = [x for j, x in enumerate(t.split("\n")) if (d, j) not in must]
        if d:  # in the first document only later lines "between" and "other" could repeat, and each stands alone
            assert out[d] == "\n".join(want), d
    assert out[0] == rows[0][1]
