"""The language model against one counted in plain dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_edges import CLASHES
from tests.llm.test_operators import LOW, SPACED, rows_of

START, STOP = "\x00start", "\x00stop"


def tokens(text):
    return [*SPACED.findall((text or "").translate(LOW)), STOP]


def discounts(counts):
    t = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if not all(t):
        return [0.0, 0.5, 1.0, 1.5]
    y = t[0] / (t[0] + 2 * t[1])
    return [0.0, *(min(max(k - (k + 1) * y * t[k] / t[k - 1], 0), k) for k in (1, 2, 3))]


class Plain:
    def __init__(self, texts):
        self.raw = Counter(w for t in texts for w in tokens(t))
        runs = Counter()
        for t in texts:
            w = [START, START, *tokens(t)]
            runs.update(zip(w, w[1:], w[2:]))
        pairs = Counter()
        for (_, b, c), n in runs.items():
            pairs[b, c] += n if b == START else 1
        singles = Counter(c for _, c in pairs)
        self.levels = []
        for counts in ({(c,): n for c, n in singles.items()}, pairs, runs):
            off, after = discounts(counts.values()), defaultdict(list)
            for key, n in counts.items():
                after[key[:-1]].append(n)
            self.levels.append((counts, off, {k: (sum(v), sum(off[min(n, 3)] for n in v)) for k, v in after.items()}))

    def probability(self, a, b, c):
        p = 1 / (len(self.raw) + 1)
        for (counts, off, after), key in zip(self.levels, ((c,), (b, c), (a, b, c)), strict=True):
            if key[:-1] in after:
                total, left = after[key[:-1]]
                n = counts.get(key, 0)
                p = (max(n - off[min(n, 3)], 0) + left * p) / total
        return p

    def score(self, text):
        w = [START, START, *tokens(text)]
        return sum(math.log10(self.probability(*x)) for x in zip(w, w[1:], w[2:]))

    def base(self, text):
        return sum(math.log10((self.raw[w] + 1) / (self.raw.total() + len(self.raw) + 1)) for w in tokens(text))


def texts(seed=1, n=120):
    rnd = random.Random(seed)
    words = [f"{x}{y}" for x in ("Ba", "de", "ño", "x") for y in ("", "n", "rt", "日")] + ["hot"] * 12
    out = [None, "", " \n", "one", "ONE one", "hot " * 300]
    return out + [" ".join(rnd.choices(words, k=rnd.randint(1, 40))) + rnd.choice(["", "\n", f" new{k}"]) for k in range(n)]


@pytest.mark.parametrize("shard", [1 << 21, 40])
def test_against_a_plain_model(spark, shard):
    """With 40 runs a shard, the common word is dealt to many shards."""
    from pyspark.sql import functions as F

    from boxquarry.llm.lm_scoring import score_texts

    data = [(None if k == 7 else k, t) for k, t in enumerate(texts())] + [(11, texts()[11])]
    frame = spark.createDataFrame(data, "doc_id long, text string").select("*", *[F.lit(k).alias(c) for k, c in enumerate([*CLASHES, "word", "n", "shard", "first"])]).repartition(3)
    model = Plain([t for d, t in data if d is not None and d % 3])
    got = rows_of(score_texts(frame, F.col("doc_id") % 3 != 0, shard=shard))
    assert len(got) == len(data)
    by_id = {d: t for d, t in data}
    for r in got:
        w = tokens(by_id[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(model.raw[x] > 0 for x in w), model.raw.total())
        assert math.isclose(r["base_score"], model.base(by_id[r["doc_id"]]), rel_tol=1e-9) and math.isclose(r["score"], model.score(by_id[r["doc_id"]]), rel_tol=1e-9)
        assert math.isclose(r["perplexity"], 10 ** (-r["score"] / len(w)), rel_tol=1e-9)
    # probabilities of all words, and of an unknown one, after the same two words
    for a, b in ((START, START), (START, "hot"), ("hot", "hot"), ("never", "seen"), ("hot", "never")):
        assert math.isclose(sum(model.probability(a, b, c) for c in [*model.raw, "unknown word"]), 1, rel_tol=1e-9)


def test_more_shards_than_parts(spark):
    """Many shards share the files of a bounded number of parts, and the rows in which they are counted; scores stay those of a plain model."""
    import os

    from pyspark.sql import functions as F

    from boxquarry.llm import lm_scoring

    data = list(enumerate(texts(seed=5, n=150)))
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    plain = Plain([t for d, t in data if d % 3])
    found = lm_scoring.learn(frame.where("doc_id % 3 != 0").select(F.coalesce("text", F.lit("")).alias("text")), shard=4)
    assert found.shards > 500
    for level in ("runs", "own", "after", "often-own", "often-after", "word-own", "word-after"):
        files = {name for f in os.listdir(found.folder) if (name := f.split(".")[0]).rsplit("-", 1)[0] == level}
        assert (level in ("after", "often-after") or files) and len(files) <= 128, (level, len(files))
    for r in rows_of(lm_scoring.score_texts(frame, F.col("doc_id") % 3 != 0, shard=4)):
        assert math.isclose(r["score"], plain.score(data[r["doc_id"]][1]), rel_tol=1e-9) and math.isclose(r["base_score"], plain.base(data[r["doc_id"]][1]), rel_tol=1e-9)


def test_tables_without_rows_to_learn(spark):
    from pyspark.sql import functions as F

    from boxquarry.llm.lm_scoring import score_texts

    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = rows_of(score_texts(frame, F.lit(False)))
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert score_texts(frame.limit(0)).collect() == []


def test_a_long_text_and_what_is_learned(spark):
    """Held-out text of the same kind is likelier than shuffled words, and a text of a megabyte is scored whole."""
    from pyspark.sql import functions as F

    from boxquarry.llm.lm_scoring import score_texts

    rnd = np.random.default_rng(3)
    step = {w: rnd.integers(0, 300, 3) for w in range(300)}

    def walk(n):
        out = [int(rnd.integers(0, 300))]
        while len(out) < n:
            out.append(int(rnd.choice(step[out[-1]])))
        return [f"w{k}" for k in out]

    held = walk(2000)
    data = [(k, " ".join(walk(300))) for k in range(40)] + [(100, " ".join(walk(250_000))), (101, " ".join(held)), (102, " ".join(rnd.permutation(held)))]
    assert len(data[40][1]) > 1 << 20
    got = {r["doc_id"]: r for r in rows_of(score_texts(spark.createDataFrame(data, "doc_id long, text string"), F.col("doc_id") < 101))}
    assert got[100]["n_tokens"] == 250_001 and got[101]["n_known"] == 2001
    assert got[101]["score"] > got[101]["base_score"] + 1000 and got[101]["score"] > got[102]["score"] + 1000
