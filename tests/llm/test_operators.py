"""The ten operators against brute force on small tables that hold nulls, empty texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def alnum(text):
    return ALNUM.findall((text or "").translate(LOW))


def rows_of(frame):
    return [r.asDict(recursive=True) for r in frame.collect()]


def corpus(seed=1, n=60):
    """Texts with copies, near copies, nulls, empty and short ones, accents and one very long text."""
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ba", "de", "ki", "lo", "mü", "Né", "po", "za") for b in ("ne", "ra", "s", "tion", "x1", "ÿ")]
    text = lambda k: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", ",", ".", "!\n"]) for _ in range(k))
    out = [None, "", "   ", "one", "One two three", "one two  three", "a\u00a0b c", text(3000)]
    while len(out) < n:
        kind = rnd.random()
        if kind < 0.5 or len(out) < 14:
            out.append(text(rnd.randint(1, 90)))
        elif kind < 0.65:
            out.append(rnd.choice(out))
        else:
            words = (rnd.choice([t for t in out if t]) or "").split(" ")
            for _ in range(rnd.randint(1, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            out.append(" ".join(words))
    return [(k * 3 % 1000, t, rnd.choice(["en", "de", None]), "s", len(t or "")) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).withColumnRenamed("source", "norm")


def test_minhash_against_all_pairs(spark):
    from boxquarry.llm.minhash_dedup import drop_near_copies, minhash_components

    data = corpus(2, 90)
    frame = spark.createDataFrame(data, DOCS)
    sets = {}
    for doc_id, text, *_ in data:
        w = SPACED.findall((text or "").translate(LOW))
        sets[doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in sets:
        for y in sets:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    for block in (256, 3):  # with 3, groups meet in many blocks
        got = {r["doc_id"]: r for r in rows_of(minhash_components(frame, block=block))}
        assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}
    kept = drop_near_copies(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d in sets if root(d) == d)
    assert minhash_components(frame.limit(0)).collect() == []


def test_minhash_null_ids_and_repeats(spark):
    from boxquarry.llm.minhash_dedup import minhash_components

    t = "a b c d e f g"
    got = rows_of(minhash_components(spark.createDataFrame([(None, t), (4, t), (4, t), (9, t), (7, None)], "doc_id long, text string")))
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("4", "4", True), ("4", "4", True), ("7", "7", True), ("9", "4", False), ("None", "None", True)]


def test_exact_dedup(spark, docs):
    from boxquarry.llm.exact_dedup import drop_exact_copies, exact_groups

    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = {}
    for d, t in data:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d))
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r["doc_id"]: r for r in rows_of(exact_groups(docs))}
        for norm, members in groups.items():
            keep = min(members)[1]
            for _, d in members:
                assert (got[d]["keep_id"], got[d]["group_size"], got[d]["kept"], got[d]["text_sha256"]) == (keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)
    # repeated rows and null ids: one stays
    same = spark.createDataFrame([(None, "x"), (1, "x "), (1, "x "), (1, "x")], "doc_id long, text string")
    got = rows_of(exact_groups(same))
    assert [r["kept"] for r in got].count(True) == 1 and {r["keep_id"] for r in got} == {1} and {r["group_size"] for r in got} == {4}
    assert exact_groups(same.limit(0)).collect() == []


def test_exact_dedup_hot_group_over_partitions(spark):
    from boxquarry.llm.exact_dedup import exact_groups

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    frame = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 > 0, 'the same text', concat('t', id % 600)) as text").repartition(5)
    got = rows_of(exact_groups(frame))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = [r for r in got if r["doc_id"] % 3]
    assert {r["group_size"] for r in hot} == {2000} and {r["keep_id"] for r in hot} == {1} and [r["doc_id"] for r in hot if r["kept"]] == [1]
    assert sum(r["kept"] for r in got) == 201


def brute_hits(text, items, window=10):
    words = alnum(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = alnum(item_text)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(str(item))
    ids = sorted(found)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    from boxquarry.llm.decontaminate import contamination_report, remove_contamination

    rnd = random.Random(5)
    words = ["ab", "cd", "ef", "gh", "é1"]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 12, 25])))) for k in range(9)] + [(20, None), (21, "..."), (None, "ab cd")]
    items.append((22, items[1][1]))
    texts = []
    for k in range(40):
        t = " ".join(rnd.choice([*words, "zz"]) for _ in range(rnd.randint(0, 60)))
        if k % 3 == 0:
            t += ", " + (rnd.choice(items[:9])[1]).upper() + "! tail"
        texts.append((k, t))
    texts += [(90, None), (91, ""), (92, " ".join(rnd.choice(words) for _ in range(4000)))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts], DOCS).withColumnRenamed("source", "Contamination")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r.values())[1:] for r in rows_of(contamination_report(docs, bench))}
    usable = [(i, t) for i, t in items if i is not None]
    assert got == {k: brute_hits(t, usable) for k, t in texts}
    from boxquarry.llm.decontaminate import contamination

    blocks = contamination(docs, bench, most_words=20).selectExpr("doc_id", "_contamination.spans as s", "_contamination.items as i")
    whole = contamination(docs, bench).selectExpr("doc_id", "_contamination.spans as s", "_contamination.items as i")
    assert sorted(map(str, blocks.collect())) == sorted(map(str, whole.collect()))
    clean = remove_contamination(docs, bench)
    assert clean.columns == docs.columns
    long_items = [(i, t) for i, t in usable if len(alnum(t)) >= 10]
    left = {r["doc_id"]: r for r in rows_of(clean)}
    for k, t in texts:
        n, hit, *_ = brute_hits(t, usable)
        if not hit:
            assert left[k]["text"] == t
        elif k in left:
            assert brute_hits(left[k]["text"], long_items)[1] == 0
    assert remove_contamination(docs, bench.limit(0)).count() == len(texts)
    assert contamination_report(docs.limit(0), bench).collect() == []


def test_passage_is_cut_and_clean_text_stays(spark):
    from boxquarry.llm.decontaminate import remove_contamination

    passage = " ".join(f"q{k}" for k in range(12))
    around = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"{around} {passage}. {around}", 0), (2, around, 7), (3, passage, 0)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in rows_of(remove_contamination(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")))}
    assert set(got) == {1, 2} and got[2]["n_chars"] == 7
    assert alnum(got[1]["text"]) == alnum(around) * 2 and got[1]["n_chars"] == len(got[1]["text"])


def test_whole_short_items_and_many_blocks(spark):
    from boxquarry.llm.decontaminate import remove_contamination

    run = lambda letter, n: " ".join(f"{letter}{k}" for k in range(n))
    items = [(1, run("p", 12)), (2, run("q", 12)), (3, "who wrote the song"), (4, f"{run('r', 6)} {run('s', 6)}")]
    # a short item in a long text; 30 % covered by each of two items; words that the second item's removal joins to the fourth item
    texts = [f"{run('w', 90)} Who wrote the song? {run('v', 90)}", f"{run('p', 12)} {run('w', 16)} {run('q', 12)}", f"{run('w', 50)} {run('r', 6)} {run('q', 12)} {run('s', 6)} {run('v', 50)}", run("w", 9), None]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    for most in (500_000, 12):
        got = {r["doc_id"]: r for r in rows_of(remove_contamination(docs, bench, most_words=most))}
        assert set(got) == {0, 2, 3, 4} and got[3]["text"] == texts[3] and got[4]["text"] is None
        assert alnum(got[0]["text"]) == alnum(f"{run('w', 90)} {run('v', 90)}") and got[0]["n_chars"] == len(got[0]["text"])
        assert alnum(got[2]["text"]) == alnum(f"{run('w', 50)} {run('v', 50)}")
    # items of the window's length or more go as a whole from under a larger limit too
    assert "p0" not in rows_of(remove_contamination(docs.where("doc_id = 5").union(spark.createDataFrame([(5, f"{run('w', 200)} {run('p', 12)}", 0)], docs.schema)), bench, longest=20))[0]["text"]


def test_license_scan(spark, docs):
    from boxquarry.llm.license_scan import license_report

    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    texts = [(1, "MIT license. Cc-By; mit LICENSE"), (2, notice), (3, None), (4, ""), (5, "cc by cc by"), (6, "gnu general public license mit"), (7, "the license"), (7, "apache license"), (8, notice.replace("hereby granted", "given"))]
    got = rows_of(license_report(spark.createDataFrame(texts, "doc_id long, text string")))
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    for (doc_id, text), r in zip(texts, sorted(got, key=lambda r: (r["doc_id"], r["n_words"], r["n_base"])), strict=True):
        w = alnum(text)
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        assert (r["doc_id"], r["n_words"], r["n_base"]) == (doc_id, len(w), len(places))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert by[(2, len(alnum(notice)))]["labels"] == "mit" and by[(2, len(alnum(notice)))]["score"] == 1.0
    assert by[(8, len(alnum(texts[-1][1])))]["labels"] == "mit"
    assert license_report(docs.limit(0)).collect() == []


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    from boxquarry.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    data = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(5000, "It's we'RE <|endoftext|>x a<b é ≠ ΑΣ İ 12.5%% a'sb\x1cq\x85r 日本 a\u0338b")]
    got = rows_of(pack(spark.createDataFrame(data, "doc_id long, text string").repartition(3), path, length=64))
    want = []
    for d, t in data:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(d, p, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in got) // 64) + 1
    assert pack(docs.limit(0), path).collect() == []


def test_minimum_bin_slack_is_exact():
    from itertools import combinations

    from boxquarry.llm.packing import fullest, minimum_bin_slack

    rnd = random.Random(3)
    for _ in range(40):
        items = [rnd.randint(1, 20) for _ in range(8)]
        room = rnd.randint(1, 60)
        counts = {k: items.count(k) for k in items}
        best = max(sum(c) for n in range(9) for c in combinations(items, n) if sum(c) <= room)
        chosen = fullest(counts, room)
        assert sum(chosen) == best and all(chosen.count(k) <= counts[k] for k in chosen)
        plan = minimum_bin_slack(counts, 20)
        used = {}
        for content, times in plan:
            assert sum(content) <= 20
            for k in content:
                used[k] = used.get(k, 0) + times
        assert used == counts


def test_line_dedup_against_all_pairs(spark):
    from boxquarry.llm.line_dedup import drop_similar_lines, line_components

    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(60)) for _ in range(12)] + ["short", "Ünï cödé line that is långer than twenty"]
    texts = []
    for k in range(30):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                line[rnd.randrange(len(line))] = rnd.choice("xyz")
            lines.append(rnd.choice(["", "  "]) + "".join(line))
        texts.append((k, "\n".join(lines) if k else None))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = rows_of(line_components(frame, bands=20, rows=3, block=4))
    normal = lambda line: re.sub("[\x20\x09-\x0d]+", " ", line.lower()).strip(" ")
    places = [(d, n, normal(x)) for d, t in texts for n, x in enumerate((t or "").split("\n")) if normal(x)]
    distinct = sorted({p[2] for p in places})
    sets = {x: {x[k : k + 5] for k in range(len(x) - 4)} for x in distinct}
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in distinct:
        for y in distinct:
            if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                parent[root(y)] = root(x)
    keep = {}
    for d, n, x in places:
        keep[root(x)] = min(keep.get(root(x), (d, n)), (d, n))
    assert {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"], r["kept"]) for r in got} == {(d, n): (*keep[root(x)], keep[root(x)] == (d, n)) for d, n, x in places}
    cleaned = {r["doc_id"]: r for r in rows_of(drop_similar_lines(frame, bands=20, rows=3))}
    assert sum(r["n_dropped"] for r in cleaned.values()) == len(places) - len(keep)
    assert line_components(frame.limit(0)).collect() == []


def test_lines_are_hashed_together_whatever_their_numbers_are(spark):
    """Where Spark gives a task several buckets, the numbers of a file's rows don't follow one another."""
    from pyspark.sql import functions as F

    from boxquarry.llm.near_dup import packed_keys

    def sketch_of(some):
        if len(some) < 100:
            raise ValueError(f"{len(some)} lines hashed at a time")
        one = np.array([int(x) for x in some.to_pylist()], dtype=np.int64)
        return np.stack([one * 7919, one * 104729], axis=1), one.astype(np.uint64)

    # the last rows come before smaller numbers, and 300,000 doesn't fit 16 bits
    frame = spark.range(0, 6000, 1, 2).select(F.when(F.col("id") % 1000 < 500, F.col("id") * 6).otherwise(300_000 + F.col("id") * 6).alias("seq")).withColumn("content", F.col("seq").cast("string"))
    packed, splits = packed_keys(frame, 6000, sketch_of, 2)
    got = sorted(
        (seq, key, sketch, r["part"])
        for r in packed.collect()
        for seq, key, sketch in zip((np.frombuffer(r["places"], np.uint16).astype(np.int64) + r["base"]).tolist(), np.frombuffer(r["keys"], np.uint32).tolist(), np.frombuffer(r["sketches"], np.uint64).tolist(), strict=True)
    )
    seqs = np.repeat([r["seq"] for r in frame.collect()], 2)
    keys = seqs * np.tile([7919, 104729], len(seqs) // 2)
    assert got == sorted(zip(seqs.tolist(), keys.astype(np.uint32).tolist(), seqs.tolist(), splits.part(keys, seqs).tolist(), strict=True))


def test_short_lines_are_linked_too(spark):
    from boxquarry.llm.line_dedup import line_components

    lines = ["Privacy policy", "privacy policy.", "abcdefgh", "abcdefghi", "abcdefg", "home", "home!", "a", "b", "Home", "th the anhely eran.", "the anhely eran."]
    got = {r["doc_id"]: r["keep_doc_id"] for r in rows_of(line_components(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), bands=200, rows=3))}
    # 10 of 11 runs, 4 of 5 and 3 of 4 (not linked), equal ones, 12 of 15
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 5, 10: 10, 11: 10}


def test_registered_bands_overlook_no_pair_at_the_limit(spark):
    from boxquarry.llm.line_dedup import line_components

    rnd = random.Random(4)
    texts = []
    for k in range(3000):
        # 45 runs each, 40 in common of 50
        line = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(49))
        texts += [(2 * k, line), (2 * k + 1, line[:24] + "#" + line[25:])]
    got = rows_of(line_components(spark.createDataFrame(texts, "doc_id long, text string")))
    assert [r for r in got if r["keep_doc_id"] != r["doc_id"] // 2 * 2] == []


def test_full_licences_are_told_apart(spark):
    from boxquarry.llm.licence_texts import FULL
    from boxquarry.llm.license_scan import license_report, license_spans

    texts = [(k, f"some words before {text} and some after") for k, (_, text) in enumerate(FULL)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in rows_of(license_report(frame))}
    for k, (label, _) in enumerate(FULL):
        assert label in got[k]
    name = {label: got[k] for k, (label, _) in enumerate(FULL)}
    assert name["bsd-3"] == ["bsd-3"] and name["isc"] == ["isc"] and name["mit"] == ["mit"] and "gpl" not in name["mpl"]
    spans = {r["doc_id"]: r["spans"] for r in rows_of(license_spans(frame))}
    assert [(s["start"], s["end"], s["label"], s["coverage"]) for s in spans[0] if s["end"] - s["start"] > 100] == [(3, 3 + len(alnum(FULL[0][1])), "mit", 1.0)]


def test_licence_chains_are_the_best_ones():
    from itertools import combinations

    from boxquarry.llm.license_scan import LicenceIndex

    index, rnd = LicenceIndex({}, [("x", " ".join(f"w{k}" for k in range(40)))]), random.Random(5)
    for _ in range(150):
        found = []
        for _ in range(rnd.randint(1, 6)):
            start, begin, size = rnd.randint(0, 25), rnd.randint(0, 25), rnd.randint(4, 9)
            found.append((start, start + size, 0, begin))
        best = 0
        for n in range(1, len(set(found)) + 1):
            for some in combinations(sorted(set(found), key=lambda m: (m[1], m[0], m[3])), n):
                total = some[0][1] - some[0][0]
                for x, y in zip(some, some[1:], strict=False):
                    common = max(0, x[1] - y[0])
                    if not (x[1] < y[1] and x[0] < y[0] and x[1] >= y[0] - index.gap and y[3] + common >= x[3] + x[1] - x[0]):
                        break
                    total += y[1] - y[0] - common
                else:
                    best = max(best, total)
        assert max(c for *_, c in index.chains(found)[0]) == best


def test_warc_round_trip(spark, tmp_path):
    from boxquarry.llm.warc import archive_pages, fetch_records, read_bundles, write_bundles

    body = lambda k: "".join(hashlib.sha256(f"{k} {n}".encode()).hexdigest() for n in range(9))
    big, small = "<p>" + "ü" * 80 + "</p>", "<p>x</p>"
    data = [(5, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (4, "u\r\nv", small), (6, "u", small), (7, "u", None), (8, "u", ""), (3, "http://a/2", big), (None, "z", big)] + [(100 + k, f"http://b/{k}", body(k)) for k in range(40)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(2)
    got = rows_of(archive_pages(pages))
    assert len(got) == len(data) and all(r["intact"] for r in got)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((str(p), len((t or "").encode()), digest(t)) for p, _, t in data)
    same = [r for r in got if r["payload_digest"] == digest(big)]
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in same) == [("3", "response", None), ("3", "revisit", 3), ("5", "revisit", 3), ("9", "revisit", 3), ("None", "revisit", 3)]
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 100)
    folder = str(tmp_path / "bundles")
    index = spark.createDataFrame(write_bundles(pages, folder, frame_bytes=2000, bundle_bytes=3000).collect(), "id long, bundle string, frame int, offset long, length long")
    assert index.select("bundle").distinct().count() > 2 and index.agg({"frame": "max"}).first()[0] > 0
    some = rows_of(fetch_records(spark, folder, index.where("id in (105, 120, 139)")))
    assert {(r["id"], r["payload"].decode()) for r in some} == {(k, body(k - 100)) for k in (105, 120, 139)}
    assert read_bundles(spark, folder, index).count() == len(data)
    assert archive_pages(pages.limit(0)).collect() == []


def test_url_rules_and_templates(spark):
    from boxquarry.llm.url_filter import RULES, judge_urls

    urls = ["http://a.example.COM/en/5", "https://example.com/en/77?x", "http://x.net/de/", "http://b.example.net/de/81#t", "http://q.org/es/1", "http://org/es/", "notaurl", None, "ftp://host", "http://badcom/en/1", "x://a/b://c/d", "http://h.com?en/"]
    urls += [f"http://spam.example.com/en/{100 + k}/x" for k in range(30)] + [f"http://spam.example.com/fr/{k}" for k in range(30)]
    got = {r["page_id"]: r for r in rows_of(judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")))}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, max(fit)[1] if fit else None)
        if fit:
            assert got[k]["verdict"] == max(fit)[2]
    assert all(got[k]["verdict"] == "allow" for k in range(len(urls) - 30, len(urls)))
    assert judge_urls(spark.createDataFrame([], "page_id int, url string")).collect() == []


def test_url_templates_are_learned(spark):
    from boxquarry.llm.url_filter import judge_urls

    rules = [("h.com", "/ads/1", "block"), ("h.com", "/news/", "allow")]
    urls = [f"http://h.com/ads/{100 + k}" for k in range(60)] + ["http://h.com/ads/900"] + [f"http://h.com/news/{k}" for k in range(60)] + ["http://h.com/about"]
    got = rows_of(judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules=rules))
    by = {urls[r["page_id"]]: r for r in got}
    assert by["http://h.com/ads/900"]["rule"] is None and by["http://h.com/ads/900"]["verdict"] == "block"
    assert by["http://h.com/about"]["verdict"] == "allow"


def synthetic_language(rnd, letters, n):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(n))


def test_language_id(spark):
    from boxquarry.llm.language_id import identify_languages

    rnd = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "fghijklm", "cc": "nopéèqrs"}
    data = [(k, synthetic_language(rnd, alphabets[lang], rnd.randint(8, 80)), lang if k % 5 else None, "s", 0) for k in range(240) for lang in [rnd.choice(list(alphabets))]]
    truth = {d: next(x for x, letters in alphabets.items() if set(t) - set(" ") <= set(letters)) for d, t, *_ in data}
    data += [(900, None, "aa", "s", 0), (901, "", "aa", "s", 0), (902, "12 34 !!", "aa", "s", 0)]
    frame = spark.createDataFrame(data, DOCS).withColumnRenamed("source", "letters")
    got = {r["doc_id"]: r for r in rows_of(identify_languages(frame, frame["doc_id"] % 3 != 1, with_rows=True))}
    assert len(got) == len(data)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902))
    held = [d for d in truth if d % 3 == 1]
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[5]["row"]["letters"] == "s"
    unlabelled = identify_languages(frame.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in rows_of(unlabelled)} == {"und"}
    assert identify_languages(frame.limit(0)).collect() == []


def test_every_language_is_learned(spark):
    from boxquarry.llm.language_id import Presence, gram_sets, identify_languages

    rnd = random.Random(3)
    # 70 languages of 6 letters each, of which the last has the fewest rows and one has long texts only
    data = []
    for lang in range(70):
        letters = "".join(chr(0x4E00 + 6 * lang + k) for k in range(6))
        data += [(100 * lang + k, synthetic_language(rnd, letters, 6000 if lang == 68 else 20), f"l{lang}") for k in range(3 if lang == 69 else 4)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in rows_of(identify_languages(frame))}
    assert got == {d: lang for d, _, lang in data}
    # of many texts in one script and one in another, both scripts' n-grams are kept
    few = Presence(gram_sets(pa.array(["abcabc", "abcab", "abca", "äö"])), ["a", "a", "a", "b"], 12)
    assert few.size >= 12 and few.matrix(pa.array(["äö"])).sum() > 2


def test_language_model_against_plain_kernels(spark):
    """The registered form, with Nystroem landmarks, against sets of n-grams in plain Python and a direct solution."""
    from boxquarry.llm.language_id import identify_languages

    rnd = random.Random(4)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "nopéèqrs"}
    data = [(k, synthetic_language(rnd, alphabets[lang], rnd.randint(3, 40)), lang) for k in range(60) for lang in [("aa", "bb", "cc")[k % 3]]]
    grams = lambda t: {(n, t[k : k + n]) for b in [t.translate(LOW).encode()] for t in [b] for n in (1, 2, 3) for k in range(len(t) - n + 1)}
    sets = [grams(t) for _, t, _ in data]
    gram = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y))
    k = np.array([[gram(x, y) for y in sets] for x in sets])
    # twenty texts a language, all of them landmarks: then Nystroem's features span the kernel's, and ridge regression has its dual form
    wanted = np.array([[1.0 if lang == name else -1.0 for name in alphabets] for *_, lang in data])
    scores = k @ np.linalg.solve(k + 1e-3 * len(data) * np.eye(len(data)), wanted)
    got = {r["doc_id"]: r for r in rows_of(identify_languages(spark.createDataFrame(data, "doc_id long, text string, lang string")))}
    for (d, *_), own in zip(data, scores, strict=True):
        assert got[d]["lang_pred"] == list(alphabets)[int(own.argmax())]
        assert abs(got[d]["score"] - min(max((own.max() + 1) / 2, 0), 1)) < 2e-3


def test_language_samples_count_rows(spark):
    """Null and repeated ids are drawn row by row, within the bound; ties of scores go to the first name."""
    from pyspark.sql import functions as F

    from boxquarry.llm.language_id import identify_languages, training_sample

    rnd = random.Random(6)
    rows = [(None, synthetic_language(rnd, "abcdef", 12), "aa") for _ in range(3000)] + [(7, synthetic_language(rnd, "uvwxyz", 12), "bb") for _ in range(3000)] + [(8, "same text", "cc")] * 2000
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = training_sample(frame, "doc_id", "text", "lang", F.lit(True), 100, 16_000)
    assert drawn["lang"].value_counts().to_dict() == {"aa": 100, "bb": 100} | {"cc": drawn["lang"].eq("cc").sum()} and 1 <= drawn["lang"].eq("cc").sum() <= 100
    assert {r["lang_pred"] for r in rows_of(identify_languages(frame.limit(50)))} == {"aa"}
    both = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in rows_of(identify_languages(both))} == {"a"}


def test_quality(spark):
    from boxquarry.llm.quality import quality_scores

    rnd = random.Random(4)
    data, labels = [], []
    for k in range(300):
        words = synthetic_language(rnd, "abcdefghij", rnd.randint(5, 60))
        bad = rnd.random() < 0.2
        data.append((k, words.upper().replace(" ", "!! ") if bad else words + ".", None, "s", 0))
        if k % 2:
            labels.append((k, 0 if bad else 1, 0))
    data += [(900, None, None, "s", 0), (901, "", None, "s", 0), (3, data[3][1], None, "s", 0)]
    labels += [(1, None, 0), (3, labels[1][1], 1)]
    frame = spark.createDataFrame(data, DOCS).withColumnRenamed("source", "label")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = rows_of(quality_scores(frame, marks, frame["doc_id"] % 4 != 2))
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    truth = {d: "!!" not in t for d, t, *_ in data if t}
    held = [r for r in got if r["doc_id"] % 4 == 2 and r["doc_id"] in truth]
    assert sum(bool(r["predicted"]) == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    again = rows_of(quality_scores(frame, marks, frame["doc_id"] % 4 != 2))
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert [r["score"] for r in rows_of(quality_scores(frame, marks.limit(0)))] == pytest.approx([0.7] * len(data))
    assert quality_scores(frame.limit(0), marks).collect() == []


def test_components_of_chains(spark):
    from boxquarry.llm.components import connected_components

    links = [(k, k + 1) for k in range(0, 40)] + [(k + 1, k) for k in range(60, 80)] + [(200, 200), (None, 3), (7, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 60 for k in range(60, 81)}


def test_splits_order_pairs_and_split_a_hot_key():
    from boxquarry.llm.near_dup import Splits

    rnd = np.random.default_rng(3)
    keys, nodes = np.where(rnd.random(3000) < 0.4, 7, rnd.integers(-50, 50, 3000)), rnd.integers(0, 10**6, 3000)
    splits = Splits(keys[::3], nodes[::3], 16)
    part, order = splits.part(keys, nodes), np.lexsort((nodes, keys))
    assert (np.diff(part[order]) >= 0).all() and 0 <= part.min() and part.max() < 16
    assert np.bincount(part).max() < 2 * 3000 / 16  # the hot key too is dealt to several ranges
    assert part.tolist() == [sum((k, n) < (x, y) for k, n in zip(splits.keys.tolist(), splits.nodes.tolist(), strict=True)) for x, y in zip(keys.tolist(), nodes.tolist(), strict=True)]
    assert Splits(keys[:0], nodes[:0], 16).part(keys, nodes).max() == 0


def test_quality_against_a_direct_fit(spark):
    """The ranker's weights against Newton's method in plain numpy on the same pairs, and the bound on rows of a repeated id."""
    from boxquarry.llm.quality import THRESHOLD, fit_ranker, quality_scores, text_features

    rnd = random.Random(8)
    texts = [synthetic_language(rnd, "abcdefghij", rnd.randint(5, 60)) + (" !!! 99 $$" * rnd.randint(1, 4) if k % 2 else ".") for k in range(120)]
    labels = np.array([1 - k % 2 for k in range(120)])
    features = text_features(pa.array(texts))
    model = fit_ranker(features, labels, pairs=500, ridge=3e-3, seed=11)
    scale = features.std(axis=0)
    x = np.clip((features - features.mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -8, 8)
    draw = np.random.default_rng(11)
    d = x[draw.choice(np.flatnonzero(labels == 1), 500)] - x[draw.choice(np.flatnonzero(labels == 0), 500)]
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(d @ w))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / 500 + 3e-3 * np.eye(len(w)), d.T @ p / 500 - 3e-3 * w)
    assert np.allclose(model.weights, w, atol=1e-6)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(v), 0) for k, v in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rows_of(quality_scores(frame, marks))}
    order = np.lexsort((*features.T[::-1], labels))
    full = fit_ranker(features[order], labels[order])
    assert np.allclose([got[k]["score"] for k in range(120)], full.score(features), atol=1e-9)
    assert all(got[k]["predicted"] == int(got[k]["score"] >= THRESHOLD) for k in got)
    many = spark.createDataFrame([(1, f"{t} {k}") for k in range(20) for t in texts], "doc_id long, text string")
    assert len(rows_of(quality_scores(many, marks, most=50))) == 2400


def test_quality_learns_from_all_rows(spark):
    """Groups of a few rows, a label rarer than the groups, and rows beyond any bound: the model moves with each labelled row."""
    from boxquarry.llm.quality import FEATURES, _fit, fit_ranker, pair_sums

    rnd = np.random.default_rng(5)
    labels = np.array([0] * 3 + [1] * 77)
    x = rnd.normal(size=(80, FEATURES)) + labels[:, None] * rnd.normal(size=FEATURES)
    good, bad, w = x[labels == 1], x[labels == 0], rnd.normal(size=FEATURES) / 10
    d = (good[:, None, :] - bad[None, :, :]).reshape(-1, FEATURES)
    p = 1 / (1 + np.exp(d @ w))
    gradient, hessian = pair_sums(good, bad, w)
    assert np.allclose(gradient, -(d.T @ p)) and np.allclose(hessian, (d * (p * (1 - p))[:, None]).T @ d)
    rows = [(int(k), n, v.tobytes()) for n, (k, v) in enumerate(zip(labels, x, strict=True))]
    fit = lambda rows, group: _fit(spark.createDataFrame(rows, "label int, place long, x binary"), group)
    one, full = fit(rows, 100), fit_ranker(x, labels)
    assert np.allclose(one.weights, full.weights, atol=1e-9) and np.isclose(one.cut, full.cut) and np.isclose(one.unit, full.unit)
    many, fewer = fit(rows, 8), fit(rows[:-1], 8)
    assert np.isfinite(many.weights).all() and not np.allclose(many.weights, fewer.weights, atol=1e-9)
    assert ((many.raw(x) > many.raw(x[:3]).max())[3:]).mean() > 0.9


def test_language_scores_of_many_short_texts_in_bounded_memory():
    import tracemalloc

    from boxquarry.llm.language_id import fit, gram_sets

    rnd = random.Random(12)
    texts = [synthetic_language(rnd, "abcdef" if k % 2 else "uvwxyz", 40) for k in range(60)]
    model = fit(gram_sets(pa.array(texts)), ["aa" if k % 2 else "bb" for k in range(60)])
    short = pa.array([texts[k % 60][:20] for k in range(20_000)])
    want = model.scores(short.slice(0, 60))
    model.presence.tables  # built once a worker
    tracemalloc.start()
    got = model.scores(short)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (20_000, 2) and np.allclose(got[:60], want, atol=1e-5) and np.allclose(got[-20:], want[(np.arange(19_980, 20_000)) % 60], atol=1e-5)
    assert peak < 4 * len(short) * model.presence.size / 2  # the texts' own matrix would be twice that
