"""Every operator and stage on a text of over a megabyte, nulls, ties, repeated rows and extra columns with clashing names."""

import hashlib
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import alnum, rows_of

#: Names that the operators use themselves.
CLASHES = ["id", "node", "seq", "unit", "digest", "class", "keys", "key", "size", "kind", "line", "line_no", "place", "component", "task", "rank", "segments", "found", "norm", "sha", "keep", "part", "row", "template", "purity", "content", "row_text"]


def long_text(words=190_000):
    rnd = np.random.default_rng(4)
    return " ".join(f"w{k}" for k in rnd.integers(0, 50_000, words))


@pytest.fixture(scope="module")
def texts():
    long = long_text()
    assert len(long) > 1 << 20
    same = "the same words stand here in a row of more than five words"
    return [(1, long), (2, None), (3, ""), (4, same), (5, same), (5, same), (6, "\n\n"), (7, long + " end"), (8, f"{same}\n{same}\n" + "x" * 300_000)]


@pytest.fixture(scope="module")
def table(spark, texts):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(d, t, "en" if d % 2 else None, "s", len(t or "")) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate(CLASHES)]).repartition(2)


def test_line_dedup_edges(table, texts):
    from boxquarry.llm.line_dedup import line_components

    got = rows_of(line_components(table))
    assert len(got) == sum(1 for _, t in texts for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c"))
    kept = sorted((r["doc_id"], r["line_no"]) for r in got if r["kept"])
    # the two long lines are one component, as are the repeated ones
    assert kept == [(1, 0), (4, 0), (8, 2)]


def test_dropping_lines_of_repeated_ids_is_an_error(spark):
    from boxquarry.llm.line_dedup import drop_similar_lines

    one = "a line that is long enough to be told apart\nanother one of some length"
    rows = [(1, one), (2, one + "\nand a third line here"), (None, "a line without an id"), (3, "")]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in rows_of(drop_similar_lines(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: (one, 0), 2: ("and a third line here", 2)}
    with pytest.raises(Exception, match="two rows share one doc_id"):
        drop_similar_lines(spark.createDataFrame([*rows, (1, one)], "doc_id long, text string")).collect()


def test_near_dedup_edges(table):
    from boxquarry.llm.minhash_dedup import drop_near_copies, minhash_components

    got = {r["doc_id"]: r for r in rows_of(minhash_components(table))}
    assert {d: r["component_id"] for d, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 1, 8: 8}
    assert got[2]["n_shingles"] == got[6]["n_shingles"] == 0
    stay = drop_near_copies(table)
    assert stay.columns == table.columns and sorted(r["doc_id"] for r in rows_of(stay)) == [1, 2, 3, 4, 6, 8]


def test_exact_dedup_edges(table, texts):
    from boxquarry.llm.exact_dedup import drop_exact_copies, exact_groups

    got = rows_of(exact_groups(table))
    assert len(got) == len(texts) and {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got} == {(1, 1, 1), (2, 6, 3), (3, 6, 3), (6, 6, 3), (4, 4, 3), (5, 4, 3), (7, 7, 1), (8, 8, 1)}
    assert next(r for r in got if r["doc_id"] == 1)["text_sha256"] == hashlib.sha256(texts[0][1].replace(" ", "").encode()).hexdigest()
    stay = drop_exact_copies(table)
    assert stay.columns == table.columns and sorted(r["doc_id"] for r in rows_of(stay)) == [1, 4, 6, 7, 8]


def test_decontamination_edges(spark, table, texts):
    from boxquarry.llm.decontaminate import contamination_report, remove_contamination

    passage = " ".join(texts[0][1].split(" ")[100_000:100_012])
    bench = spark.createDataFrame([(1, passage, 0), (2, None, 0), (3, "", 0), (1, passage, 0)], "item_id long, text string, id int")
    got = rows_of(contamination_report(table, bench))
    assert len(got) == len(texts) and {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in got if r["n_words"] > 1000} == {1: (190_000, 12, 1), 7: (190_001, 12, 1)}
    left = remove_contamination(table, bench)
    assert left.columns == table.columns
    assert {r["doc_id"]: len(alnum(r["text"])) for r in rows_of(left) if r["doc_id"] in (1, 7)} == {1: 189_988, 7: 189_989}


def test_language_edges(table, texts):
    from boxquarry.llm.language_id import identify_languages

    got = rows_of(identify_languages(table))
    assert len(got) == len(texts) and all((r["lang_pred"] == "und") == (r["doc_id"] in (2, 3, 6)) and 0 <= r["score"] <= 1 for r in got)
    assert rows_of(identify_languages(table.limit(0))) == []


def test_license_edges(table, texts):
    from boxquarry.llm.license_scan import license_report

    got = rows_of(license_report(table))
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["labels"]) for r in got) == sorted((d, len(alnum(t)), 0, "") for d, t in texts)


def test_packing_edges(table, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from boxquarry.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    got = rows_of(pack(table, path))
    plain = Tokenizer.from_file(path)
    want = []
    for d, t in texts:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(d, p, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)


def test_quality_edges(spark, table, texts):
    from boxquarry.llm.quality import quality_scores

    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = rows_of(quality_scores(table, labels))
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert len(rows_of(quality_scores(table, labels.limit(0)))) == len(texts)


def test_url_edges(spark):
    from pyspark.sql import functions as F

    from boxquarry.llm.url_filter import judge_urls

    deep = "http://h.example.com/" + "/".join(f"s{chr(97 + k % 26)}" for k in range(500))
    urls = [(1, deep), (1, deep), (2, None), (3, ""), (4, "no scheme"), (5, "http://" + "y" * 1_200_000), (6, "http://h.example.com")]
    pages = spark.createDataFrame(urls, "page_id long, url string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHES)])
    got = rows_of(judge_urls(pages))
    assert sorted(r["page_id"] for r in got) == [1, 1, 2, 3, 4, 5, 6] and all(r["verdict"] == "allow" and r["rule"] is None for r in got)
    assert [r["template"].count("/") for r in got if r["page_id"] == 1] == [500, 500]


def test_an_unlabelled_branch_beside_a_blocked_one_is_not_blocked(spark):
    from boxquarry.llm.url_filter import judge_urls

    urls = [f"http://a.org/es/{'abcdefghij'[k % 10]}x{k}" for k in range(40)] + [f"http://a.org/free/{'abcdefghij'[k % 10]}x{k}" for k in range(40)]
    got = rows_of(judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")))
    assert {(r["page_id"] < 40, r["verdict"]) for r in got} == {(True, "block"), (False, "allow")}


def test_warc_edges(spark, texts):
    from pyspark.sql import functions as F

    from boxquarry.llm.warc import archive_pages

    pages = spark.createDataFrame([(d, f"http://x/{d}", t) for d, t in texts], "page_id long, url string, html string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(CLASHES)])
    got = rows_of(archive_pages(pages))
    assert len(got) == len(texts) and all(r["intact"] for r in got)
    assert {r["page_id"]: r["payload_bytes"] for r in got} == {d: len((t or "").encode()) for d, t in texts}


def test_pipeline_edges(spark, table, texts, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([(1, " ".join(texts[0][1].split(" ")[5:17]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == table.columns
    assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == [1, 4, 8]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == 3
