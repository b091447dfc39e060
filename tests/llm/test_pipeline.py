"""The pipeline against a brute-force version of its stages on a small corpus."""

import random
import re
import zlib

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(rnd.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(14)
    texts = [text(rnd.randint(30, 80)) for _ in range(24)]
    texts += [texts[0], texts[0].replace(" ", "  "), texts[1] + " tail", f"{texts[2]} more", None, "", "12 34", texts[3].replace(" ", "\n", 1)]
    texts += [f"{text(40)} {passage.upper()} {text(20)}", passage, f"{text(3)} {passage}", text(2)]
    docs = [(k, t, rnd.choice(["xx", "yy"]), "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {k: t for k, t, *_ in docs if t and re.search(r"[^\W\d_]", t)}
    best = {}
    for k, t in kept.items():
        key = re.sub("[\x20\x09-\x0d]", "", t)
        best[key] = min(best.get(key, (1, 0)), (-len(t), k))
    kept = {k: kept[k] for _, k in best.values()}
    sets = {}
    for k, t in kept.items():
        w = SPACED.findall(t.translate(LOW))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    parent = {k: k for k in kept}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in kept:
        for y in kept:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    kept = {k: t for k, t in kept.items() if root(k) == k}
    item = ALNUM.findall(passage.translate(LOW))

    def hits(t):
        w = ALNUM.findall(t.translate(LOW))
        return {j for i in range(len(item) - 9) for j0 in range(len(w) - 9) if w[j0 : j0 + 10] == item[i : i + 10] for j in range(j0, j0 + 10)}, len(w)

    docs_now, last = None, None
    for name, stage in corpus_pipeline.STAGES:
        docs_now = stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet") if docs_now is None else docs_now, str(tmp_path))
        if name != "packing":
            assert docs_now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":
            assert {r["doc_id"]: r["text"] for r in docs_now.collect()} == kept
        if name == "decontamination":
            last = {r["doc_id"]: r["text"] for r in docs_now.collect()}
    for k, t in kept.items():
        found, n = hits(t)
        if not found:
            assert last[k] == t
        elif len(found) > n / 2:
            assert k not in last
        else:
            assert not hits(last[k])[0] and len(ALNUM.findall(last[k])) == n - len(found)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for k, t in last.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(k, p, zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)


def test_near_dedup_links_from_four_fifths_on(spark):
    import corpus_pipeline

    # n shingles of which 5 differ on each side: n - 5 shared of n + 5, 0.818 for 50, 0.8 for 45 and 0.795 for 44
    words = lambda seed, n: [f"w{seed}x{k}" for k in range(n)]
    docs = []
    for at, n in enumerate((50, 45, 44)):
        one = words(at, n + 4)
        other = [*one[: n // 2], "other", *one[n // 2 + 1 :]]
        docs += [(2 * at, " ".join(one), 0), (2 * at + 1, " ".join(other), 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [0, 2, 4, 5]


def test_language_stage_without_labels_keeps_texts_with_letters(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "plain words", None), (2, None, None), (3, "", None), (4, "12 !", None), (5, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 5]


def test_language_stage_rejects_by_the_score(spark):
    """Texts of one language stay, held-out ones too; mixtures of all languages, which none claims, go."""
    import corpus_pipeline
    from tests.llm.test_operators import synthetic_language

    rnd = random.Random(9)
    alphabets = ["abcdefgh", "ijklmnop", "qrstuvwx", "αβγδεζηθ", "абвгдежз"]
    data = [(k, synthetic_language(rnd, alphabets[k % 5], rnd.randint(10, 60)), f"l{k % 5}" if k < 150 else None) for k in range(300)]
    mixed = [(1000 + k, " ".join(synthetic_language(rnd, letters, 12) for letters in rnd.sample(alphabets, 5)), None) for k in range(40)]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, spark.createDataFrame(data + mixed, "doc_id long, text string, lang string"), "").collect()}
    assert kept >= {d for d, *_ in data} and len(kept & {d for d, *_ in mixed}) <= 2


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
