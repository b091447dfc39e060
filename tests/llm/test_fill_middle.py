"""Fill-in-middle against a plain reading of each text, with chunks of all small sizes."""

import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.test_edges import CLASHES
from tests.llm.test_operators import rows_of

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def expected(doc_id, text, seed=42, rate=50, suffix_first=80):
    text = text or ""
    units, digest = TOKEN.findall(text), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(n=150, seed=3):
    rnd = random.Random(seed)
    parts = ["a", "bc", "é", "日本", "<", "<P", "<S>", "P>", ">", " ", "  ", "\n", "\t ", " ", "S", "M>", "𝄞x"]
    out = [None, "", " ", "<P>", "<M", "a", "\n\n", "x <S> y"]
    return out + ["".join(rnd.choices(parts, weights=[6, 6, 6, 6, 1, 1, 0.3, 1, 1, 8, 3, 3, 2, 2, 1, 1, 3], k=rnd.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [4, 7, 64, 1 << 16])
def test_against_a_plain_reading(spark, chunk):
    from boxquarry.llm.fill_middle import fill_in_middle, restore

    from pyspark.sql import functions as F

    data = [(None if k == 9 else k, t) for k, t in enumerate(texts())] + [(20, texts()[20]), (21, texts()[20])]
    docs = spark.createDataFrame(data, "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate([*CLASHES, "n", "form", "output", "chunk", "h1"])])
    for rate, seed in ((50, 42), (100, 7)):
        found = fill_in_middle(docs, rate=rate, seed=seed, chunk=chunk)
        got = rows_of(found.withColumn("again", restore(F.col("output"), F.col("form"))))
        assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in got), key=str) == sorted(((d, *expected(d, t, seed, rate), t or "") for d, t in data), key=str)
    assert fill_in_middle(docs.limit(0), chunk=chunk).collect() == []


def test_long_text(spark):
    from boxquarry.llm.fill_middle import fill_in_middle

    rnd = random.Random(5)
    long = "".join(rnd.choice(["wörd", "a", " ", "\n ", "<", "P"]) for _ in range(400_000))
    got = rows_of(fill_in_middle(spark.createDataFrame([(k, long) for k in range(3)], "doc_id long, text string"), rate=100))
    assert sorted((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == [(k, *expected(k, long, rate=100)) for k in range(3)]


def test_functions_compose():
    """The function of a text is that of its chunks one after another, from each state."""
    from boxquarry.llm.fill_middle import STATES, chunk_functions, compose_all

    for text in texts(60, 8):
        raw = (text or "").encode()
        data = np.frombuffer(raw, dtype=np.uint8)
        whole = chunk_functions(data, np.array([0, len(raw)]))
        for size in (1, 2, 5):
            bounds = np.append(np.arange(0, len(raw), size), len(raw))
            after, counts = compose_all(*chunk_functions(data, bounds))
            if len(raw):
                assert (after[-1] == whole[0][0]).all() and (counts[-1] == whole[1][0]).all() and len(after[-1]) == STATES
