"""Training-data operators against brute force, round trips and held-out accuracy on small tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: id, text, source: nulls, empty and long texts, ties, repeated rows, ids that repeat.
ODD = [
    (1, "One two three four five six seven", "b"), (2, "one TWO three four five six seven", "a"), (3, None, None),
    (4, "", "a"), (5, " \n\t ", "a"), (6, "word", "a"), (7, "Word", None), (8, "x" * 50_000, "b"),
    (9, "lorem ipsum dolor sit amet " * 3000, "b"), (9, "lorem ipsum dolor sit amet " * 3000, "b"),
    (10, "né à Łódź, don't STOP 12 ½ <|endoftext|> 日本語", "c"), (None, "no id at all", "c"), (None, None, None),
    (11, "a\u00a0b\x1cc", "c"), (12, "one two three four five six seven", "b"),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def documents(spark, n=None):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs if n is None else docs.limit(n)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1 -----------------------------------------------------------------------------------------------
def test_url_filter_against_scan_of_all_rules(spark):
    from tidewake.llm.url_filter import judge_urls

    rules = [("net", "/", "block"), ("a.net", "/x/", "allow"), ("com", "/de/", "block"), ("b.com", "/", "allow"), ("net", "/", "block"), (None, "/", "block")]
    rules += [(f"host{i}.org", f"/{'p' * (i % 5)}", "block") for i in range(500)]
    urls = ["http://A.net/x/1", "http://anet/x/", "https://q.a.net/x", "ftp://net", "http://net?x", "no scheme", None, "", "http://b.com/de/#f",
            "http://c.com/de/y?z", "://net/q", "http://host7.org/pp/z", "http://s.host7.org/ppp", "http://host8.org/", "http://a://b.net/c"]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls * 2)], "page_id int, url string, rule string")
    got = rows_of(judge_urls(table, spark.createDataFrame(rules, "host string, path string, verdict string")), "page_id", "host", "path", "rule", "verdict")

    def judged(url):
        host = path = ""
        if url and "://" in url:
            rest = re.match(r"[^?#]*", url.split("://", 1)[1])[0]
            host = re.match(r"[^/]*", rest)[0]
            path = rest[len(host):]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[2:] if fits else (None, "allow"))

    assert got == sorted(((i, *judged(u)) for i, u in enumerate(urls * 2)), key=repr)
    assert judge_urls(table.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert judge_urls(table, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict = 'allow'").count() == 30


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    from tidewake.llm.url_filter import _marks, build_filter

    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = build_filter(keys)
    hashed = lambda df: df.select(F.xxhash64("key")).toPandas().iloc[:, 0].to_numpy()

    def hits(values):
        block, mark = _marks(values, len(bits))
        return ((bits[block] & mark) == mark).all(axis=1)

    assert hits(hashed(keys)).all()
    assert hits(hashed(spark.range(20000).select(F.concat(F.lit("other"), "id").alias("key")))).mean() < 0.02


# 2 -----------------------------------------------------------------------------------------------
def test_fingerprints_against_brute_force(spark):
    from tidewake.llm.fingerprints import fingerprint_edits

    docs = documents(spark).select("doc_id", "text").union(frame(spark).select(F.col("doc_id") + 10**6, "text"))
    got = fingerprint_edits(docs).toPandas()
    # order of rows with equal or NULL ids: by descending text
    order = sorted(docs.collect(), key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    texts = [r[1] or "" for r in order]
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following)]
    want = sorted((len(t), hashlib.sha256(e.encode()).hexdigest()) for t, e in zip(texts, edited))
    assert sorted(zip(got["n_chars"], got["edited_sha256"])) == want

    def grams(t):
        b = t.encode()
        return {b[i : i + 16] for i in range(len(b) - 15)} if len(b) > 16 else {b} - {b""}

    by_text = defaultdict(set)
    errors = []
    ids = {r[0]: (t, e, n) for r, t, e, n in zip(order, texts, edited, following)}
    for row in got.itertuples():
        if row.doc_id == row.doc_id and Counter(r[0] for r in order)[row.doc_id] == 1:
            t, e, n = ids[int(row.doc_id)]
            by_text[t].add(row.fingerprint)
            by_text[e].add(row.edited_fingerprint)
            a, b = grams(t), grams(e)
            errors.append(abs(row.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)))
            assert 0 <= row.near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())
    assert np.mean(errors) < 0.05
    assert fingerprint_edits(docs.limit(0)).count() == 0


def test_sketches_merge_and_estimate_containment():
    from tidewake.llm.fingerprints import from_text, merged, overlap, sketches, to_text

    rng = random.Random(4)
    big = " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(20000)).encode()
    part, other = big[40_000:60_000], " ".join("".join(rng.choices("klmnop", k=7)) for _ in range(2000)).encode()
    sketch_big, sketch_part, sketch_other = sketches([big, part, other])
    assert overlap(sketch_part, sketch_big)[1] > 0.99 and overlap(sketch_big, sketch_part)[1] < 0.25
    assert overlap(sketch_other, sketch_big) == (0.0, 0.0)
    both = merged(sketch_part, sketch_other)
    assert overlap(sketch_part, both)[1] == 1.0 and overlap(sketch_other, both)[1] == 1.0
    bound, keys = from_text(to_text(sketch_part))
    assert bound == sketch_part[0] and (keys == sketch_part[1]).all()


# 3 -----------------------------------------------------------------------------------------------
def test_mix_meets_targets(spark):
    from tidewake.llm.mixing import mix_sources, usual_word_length, word_count

    docs = documents(spark).select("doc_id", "text", "source").union(frame(spark).select(F.col("doc_id") + 10**6, "text", "source"))
    docs = docs.withColumn("size", F.lit("clash"))
    size = word_count(F.col("text"))
    mixed = mix_sources(docs, size, usual_word_length(F.coalesce("text", F.lit("")), size)).toPandas()
    assert len(mixed) == docs.count()
    sizes = sorted(len(WORD.findall(r[0] or "")) for r in docs.select("text").collect())
    assert sorted(mixed["size"]) == sizes
    assert (mixed["taken"] <= 3 * mixed["size"]).all() and (mixed["taken"] >= 0).all()
    by = mixed.fillna({"source": "~"}).groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["source_size"]).all()
    assert (abs(by["taken"] - by["target"]) < 1).all()
    # targets: water filling by rounds
    names = sorted(by.index, key=lambda s: (s == "~", s.encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = by["size"].sum(), set()
    while True:
        rest = total - sum(3 * by["size"][s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, t in share.items() if t > 3 * by["size"][s]}
        if not over:
            break
        full |= over
    for s in names:
        assert by["target"][s] == pytest.approx(3 * by["size"][s] if s in full else share[s])
    # whole epochs come before a part, which is a prefix by key: all but one document per source is taken whole
    odd = mixed[(mixed["size"] > 0) & (mixed["taken"] % mixed["size"].where(mixed["size"] > 0, 1) != 0)]
    assert odd.fillna({"source": "~"}).groupby("source").size().max() <= 1


def test_mix_weights_and_empty_table(spark):
    from tidewake.llm.mixing import mix_sources, mixed_documents

    rows = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit(10).cast("long").alias("n"))
    mixed = mix_sources(rows, F.col("n"), F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)).toPandas()
    first = mixed[mixed["source"] == "0"]  # weighs 1 of 6: half an epoch
    assert first["taken"].sum() == 10_000
    heavy = first[first["doc_id"] % 2 == 0]["taken"].mean() / first[first["doc_id"] % 2 == 1]["taken"].mean()
    assert 2 < heavy < 4.5
    assert mix_sources(rows.limit(0), F.col("n"), F.lit(1.0)).count() == 0
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(i % 7)), "s" if i % 4 else None, 1) for i in range(40)], "doc_id long, text string, source string, n_chars long")
    made = mixed_documents(docs)
    assert made.columns == docs.columns
    taken = made.select(F.col("source"), F.size(F.split("text", " ")).alias("w")).groupBy("source").sum("w").collect()
    assert sum(r[1] for r in taken) == pytest.approx(sum(i % 7 for i in range(40)), abs=2)


# 4 -----------------------------------------------------------------------------------------------
def test_quality_rules_rank_held_out_documents(spark):
    from tidewake.llm.quality_rules import held_out, score_quality

    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("score", F.lit("clash"))
    labels = spark.read.parquet(f"{path}/labels.parquet")
    scored = score_quality(docs, labels).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "quality").toPandas()
    ranks = scored["score"].rank()
    good = scored["quality"] == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95
    assert ((scored["score"] >= 0.3) == good).mean() > 0.9


def test_quality_rules_edge_cases(spark):
    from tidewake.llm.quality_rules import score_quality

    nothing = spark.createDataFrame([], "doc_id long, quality int")
    got = score_quality(frame(spark), nothing)
    assert got.columns == ["doc_id", "text", "source", "score"] and got.where("score between 0 and 1").count() == len(ODD)
    one_kind = spark.createDataFrame([(i, 1) for i in range(12)] + [(None, 1), (1, None)], "doc_id long, quality int")
    assert score_quality(frame(spark), one_kind).where("score > 0.5").count() == len(ODD)
    mixed = spark.createDataFrame([(i, i % 2) for i in range(12)] * 2, "doc_id long, quality int")
    assert score_quality(frame(spark), mixed).where("score between 0 and 1").count() == len(ODD)
    assert score_quality(frame(spark).limit(0), mixed).count() == 0


# 5 and 6 -------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return path, tokenizer


def test_codec_equals_library(spark, library):
    from tidewake.llm.bpe_codec import encode_decode

    path, tokenizer = library
    docs = documents(spark).select("doc_id", "text").union(frame(spark).select("doc_id", "text"))
    got = encode_decode(docs, path, ids=True, text=True).toPandas()
    want = []
    for doc_id, text in docs.collect():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back))
    assert sorted(zip(got["n_tokens"], got["ids_sha256"], got["decoded_sha256"], got["decoded"])) == sorted(want)
    assert (got["ids"].str.len() == got["n_tokens"]).all()
    assert encode_decode(docs.limit(0), path).count() == 0


def test_encoder_on_random_code_points(library):
    from tidewake.llm.bpe import WordEncoder, ids_only

    path, tokenizer = library
    rng, texts = random.Random(5), []
    ranges = [(32, 127), (0, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0x1F300, 0x1F700), (32, 33)]
    for _ in range(500):
        texts.append("".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(30)))
    texts += ["a" * 3000, "H̱ á ﬁ ſ K", "'S 'T o'clock 'sx", "x<|startoftext|>y <|ENDOFTEXT|>", "Σίσυφος ΣΑΣ İ", "\x00\x01 \x7f", "日本" * 500]
    for text, words in zip(texts, ids_only(WordEncoder(path)).of([t.encode() for t in texts])):
        assert [i for w in words for i in w] == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, library, tmp_path):
    from tidewake.llm.token_files import read_tokens, write_tokens

    path, tokenizer = library
    docs = documents(spark).select("doc_id", "text").union(frame(spark).select(F.col("doc_id") + 10**6, "text"))
    write_tokens(docs, path, str(tmp_path / "tokens"), shard_docs=50)
    got = read_tokens(spark, str(tmp_path / "tokens"), with_ids=True).orderBy("start").toPandas()
    ids = {}
    for doc_id, text in docs.collect():
        ids.setdefault(doc_id, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    names = [None if d != d else int(d) for d in got["doc_id"]]
    assert names == sorted(names, key=lambda d: (d is not None, d or 0))
    start = 0
    for name, row in zip(names, got.itertuples()):
        assert row.start == start and list(row.ids) in ids[name] and row.n_tokens == len(row.ids)
        assert row.ids_crc32 == zlib.crc32(np.array(row.ids, "<u4").tobytes())
        ids[name].remove(list(row.ids))
        start += row.n_tokens
    assert not any(ids.values())
    assert len(os.listdir(tmp_path / "tokens")) > 4
    write_tokens(docs.limit(0), path, str(tmp_path / "none"))
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_token_files_are_bounded_in_tokens(spark, library, tmp_path):
    from tidewake.llm.token_files import read_tokens, write_tokens

    path, tokenizer = library
    texts = [f"w{i} " * (i % 90) for i in range(120)] + ["long text " * 2000]
    docs = frame(spark, [(None if i < 60 else 7, t, "s") for i, t in enumerate(texts)])  # ids that no quantile can cut
    write_tokens(docs, path, str(tmp_path / "tokens"), file_tokens=600)
    files = spark.read.parquet(str(tmp_path / "tokens"))
    longest = max(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
    sizes = sorted(r["n_tokens"] for r in files.collect())
    assert len(sizes) > 10 and sizes[-1] == longest and sizes[-2] <= 600
    got = read_tokens(spark, str(tmp_path / "tokens"), with_ids=True).orderBy("start").collect()
    want = sorted(([*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts))
    assert sorted(list(r["ids"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert [r["doc_id"] for r in got] == [None] * 60 + [7] * 61


@pytest.mark.parametrize("n", [0, 1, 511, 512, 5000])
def test_wavelet_matrix_answers_like_an_array(n):
    from tidewake.llm.wavelet import WaveletMatrix, encode

    values = np.random.default_rng(n).zipf(1.3, n).clip(0, 49_407).astype(np.uint16)
    matrix = WaveletMatrix(encode(values, 16, np.array([7]), np.array([n])))
    assert (matrix.values() == values).all() and matrix.doc_ids.tolist() == [7]
    for i in range(0, n, max(1, n // 40)):
        value = int(values[i])
        assert matrix.access(i) == value
        assert matrix.rank(value, i) == int((values[:i] == value).sum())
        assert matrix.select(value, matrix.rank(value, i)) == i
    assert matrix.rank(49_000, n) == int((values == 49_000).sum()) and matrix.rank(1 << 20, n) == 0
    with pytest.raises(IndexError):
        matrix.select(50_000, 0)


# 7 -----------------------------------------------------------------------------------------------
def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(sets, percent=85):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def near_copies(n=40, groups=6, seed=3):
    """Groups whose members differ by a few words each, chains among them, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(groups):
        base = [word() for _ in range(150 + 40 * g)]
        for _ in range(n):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
        chain = list(base)
        for _ in range(8):
            for _ in range(2):
                chain[rng.randrange(len(chain))] = word()
            rows.append(" ".join(chain))
    rows += [" ".join([word() for _ in range(rng.randrange(5, 90))] + passage + [word() for _ in range(20)]) for _ in range(120)]
    rng.shuffle(rows)
    return [(i * 3, t, "s") for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_text_equals_brute_force(spark, monkeypatch, block):
    from tidewake.llm import near_text

    monkeypatch.setattr(near_text, "BLOCK", block)
    data = near_copies() + [(10**6 + (r[0] or 0), r[1], r[2]) for r in ODD if r[0] is not None]
    got = {}
    for r in near_text.near_duplicates(frame(spark, data)).collect():
        got[r[0]] = tuple(r)[1:]
    sets = [shingles(t) for _, t, _ in data]
    roots = brute_components(sets)
    least = {}
    for (i, _, _), r in zip(data, roots):
        least[r] = min(i, least.get(r, i))
    for (i, _, _), s, r in zip(data, sets, roots):
        assert got[i] == (len(s), least[r], i == least[r])


def test_near_text_odd_rows_and_one_of_each(spark):
    from tidewake.llm.near_text import near_duplicates, one_of_each

    rows = near_duplicates(frame(spark)).collect()
    assert len(rows) == len(ODD)
    by_id = {r[0]: tuple(r)[1:] for r in rows}
    assert by_id[2] == by_id[12] == (3, 1, False) and by_id[7] == (1, 6, False) and by_id[4] == (0, 4, True)
    kept = rows_of(one_of_each(frame(spark)), "doc_id")
    assert kept == sorted(((i,) for i in (1, 3, 4, 5, 6, 8, 9, 10, None, None, 11)), key=repr)
    assert near_duplicates(frame(spark).limit(0)).count() == 0 and one_of_each(frame(spark).limit(0)).count() == 0


def test_one_of_each_from_a_similarity_of_80_percent(spark):
    from tidewake.llm.near_text import BAND_VALUES, MISS, one_of_each, permutations

    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    texts = []
    for _ in range(30):  # 86 common of 106 shingles: 0.811
        base = [word() for _ in range(100)]
        texts += [" ".join(base), " ".join("changed" if i in (30, 60) else w for i, w in enumerate(base))]
    for _ in range(10):  # 81 common of 111: 0.730
        base = [word() for _ in range(100)]
        texts += [" ".join(base), " ".join("changed" if i in (20, 50, 80) else w for i, w in enumerate(base))]
    kept = one_of_each(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), percent=80)
    assert len(set(brute_components([shingles(t) for t in texts], 80))) == 50
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(0, 60, 2), *range(60, 80)]
    assert permutations(85) == 60
    for percent in (50, 80, 85, 100):
        assert (1 - (percent / 100) ** BAND_VALUES) ** (2 * permutations(percent) // BAND_VALUES) <= MISS


def test_near_text_fetches_one_text_of_a_class(spark):
    from tidewake.llm import near_text

    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(30)]
    docs = frame(spark, [(i, t, "s") for t in texts for i in (None, 5)] + [(5, texts[0], "s")] * 9)  # two ids with 30 texts each, one row repeated
    rows = near_text.sketch(docs, 5, 60)
    classes = rows.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "mark")).alias("source"))
    got = near_text._texts(classes.select("class"), classes, docs).collect()
    assert len(got) == 30 and sorted(r["text"] for r in got) == sorted(texts)


def test_components_of_a_long_path(spark):
    from tidewake.llm.components import components

    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(900, 800), (800, 900)], "a long, b long"))
    got = {r[0]: r[1] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 900: 800}


# 8 -----------------------------------------------------------------------------------------------
class BrutePPM:
    """PPM, method C with exclusion, over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            s = bytes([255] * order) + t.encode() + bytes([255])
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.seen[s[i - k : i]][s[i]] += 1

    def log10(self, context, symbol):
        excluded, total = set(), 0.0
        for k in range(self.order, -1, -1):
            counts = self.seen.get(context[len(context) - k :], {})
            if not counts:
                continue
            free = {s: n for s, n in counts.items() if s not in excluded}
            whole = sum(free.values()) + len(free)
            if symbol in free:
                return total + math.log10(free[symbol] / whole)
            if free:
                total += math.log10(len(free) / whole)
            excluded |= set(counts)
        return total - math.log10(256 - len(excluded))

    def score(self, text):
        s = bytes([255] * self.order) + text.encode() + bytes([255])
        return sum(self.log10(s[i - self.order : i], s[i]) for i in range(self.order, len(s)))


@pytest.mark.parametrize("held", [1 << 20, 500, 0])
def test_ppm_equals_brute_force(spark, held):
    from tidewake.llm.ppm import ORDER, score_texts

    rows = [(r[0], (r[1] or "")[:700], r[2]) for r in documents(spark, 60).select("doc_id", "text", "source").collect()]
    rows += [(r[0] and r[0] + 10**6, r[1] and r[1][:300], r[2]) for r in ODD]
    out = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    flag = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    got = score_texts(frame(spark, rows), flag, held_keys=held).collect()
    train = [t or "" for i, t, _ in rows if not out(i)]
    lower = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counts = Counter(w for t in train for w in [*lower(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    model = BrutePPM(train, ORDER)
    want = []
    for i, t, _ in rows:
        tokens = [*lower(t), "\n"]
        want.append((i, out(i), len(tokens), sum(counts[w] > 0 for w in tokens), n,
                     sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), model.score(t or "")))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_ppm_probabilities_sum_to_one_and_empty_tables(spark):
    from tidewake.llm.ppm import score_texts

    model = BrutePPM(["abracadabra", "abc"], 4)
    for context in (b"\xff\xff\xff\xff", b"abra", b"zzzz", b"xabr"):
        assert sum(10 ** model.log10(context, s) for s in range(256)) == pytest.approx(1)
    assert score_texts(frame(spark).limit(0), F.lit(False)).count() == 0
    untrained = score_texts(frame(spark, ODD[:2]), F.lit(True)).collect()
    assert [r["score"] for r in untrained] == pytest.approx([-math.log10(256) * (len(r[1]) + 1) for r in ODD[:2]])


# 9 -----------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body>
<header><p>Site of the many things that are here for you and for me</p></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies and that is what we do for all of you</div>
<article><h1>Title &amp; more</h1><p>First&nbsp;line<br>goes
 on <b>bold</b> <a href="x">link</a>.<p>x &lt; y<div class="ad">Buy it now, it is the best of all</div>
<form>Name <input></form><p>Last</p><section id="comments"><p>I think that this is what it was</p></section></article>
<aside>See also what the others have to say about it</aside><footer>&copy; all of it</footer>"""


def test_main_text_of_a_page():
    from tidewake.llm.html_text import main_text

    assert main_text(PAGE) == "Title & more\nFirst line goes on bold link.\nx < y\nLast"


def test_main_text_without_article():
    from tidewake.llm.html_text import main_text

    prose = "This is the story of a man who went to the sea and who did not come back to his house for many years, and it was told by all of them in the town. "
    page = f"<body><div>Home</div><ul><li><a href=a>One</a></li><li><a href=b>Two of them</a></li></ul><h2>About</h2><p>{prose * 2}</p><p>So it was.</p><p>{prose * 2}</p><div>xx yy zz qq ww ee rr tt yy uu ii oo pp aa ss dd ff gg hh jj kk ll zz xx cc vv bb nn</div><p>Imprint</p>"
    text = main_text(page)
    assert text.count("\n") == 2 and "So it was." in text and "Home" not in text and "One" not in text and "Imprint" not in text and "xx" not in text


@pytest.mark.parametrize("opening, closing", [
    ("<article class='post no-sidebar'>", "</article>"), ("<main class='has-comments'>", "</main>"),
    ("<div class='layout with-sidebar'><article>", "</article></div>"), ("<div id=no-menu><div class='with-sidebar'><main>", "</main></div></div>"),
    ("<div class='layout with-sidebar'>", "</div>"), ("<div class='with-sidebar'><article>", "")])
def test_main_text_in_elements_with_names_of_a_layout(opening, closing):
    from tidewake.llm.html_text import main_text

    prose = "This is the story of a man who went to the sea and who did not come back to his house for many years, and it was told by all of them in the town. " * 2
    page = f"<body><nav>{prose * 9}</nav>{opening}<p>{prose}</p><div class=ad>Buy it now, it is the best of all</div><p>{prose}</p>{closing}"
    if closing:
        page += "<div class=related>What the others have to say</div>"
    assert main_text(page) == "\n".join([prose.strip()] * 2)


def test_extract_text_edge_cases(spark):
    from tidewake.llm.html_text import extract_text

    odd = [None, "", "<", "<p", "<!-- open", "<script>x", "</div></p>", "plain", "<article>" + "<p>a &#x41; b</p>" * 5000 + "</article>", "<article><p>a<article>b</article>"]
    pages = spark.createDataFrame([(i, None, h, "x") for i, h in enumerate(odd)] * 2, "page_id long, url string, html string, text string")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 2 * len(odd)
    by = {r[0]: r[2] for r in got.collect()}
    assert by[0] == by[1] == "" and by[8] == "\n".join(["a A b"] * 5000) and by[9] == "a\nb"
    assert got.where("n_chars <> char_length(text)").count() == 0
    real = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extract_text(real).join(real.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)
        blocks = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)>", "\0", inside[1])).split("\0")
        import html

        assert r["text"] == "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)


# 10 ----------------------------------------------------------------------------------------------
def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 10, d))
    rows = base[rng.integers(0, len(base), n)] + rng.standard_normal((n, d)) * rng.choice([0.0, 0.1, 0.2, 0.28], n)[:, None]
    return rows.astype(np.float32)


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_against_all_pairs(spark, monkeypatch, block):
    from tidewake.llm import near_vectors as module

    monkeypatch.setattr(module, "BLOCK", block)
    rows = clustered(1500, 64, 1)
    rows[:200] = rows[0] + np.random.default_rng(2).standard_normal((200, 64)).astype(np.float32) * 0.05  # one large group
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(1500) * 2, "embedding": list(rows.tolist())}), "vec_id long, embedding array<float>")
    got = {r[0]: tuple(r)[1:] for r in module.near_vectors(table).collect()}
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    found, true = sum(g[0] for g in got.values()), int(linked.sum())
    assert found >= 0.98 * true
    assert all(got[2 * i][0] <= linked[i].sum() for i in range(1500))
    label = module._forest(linked)
    assert np.mean([got[2 * i][1] == 2 * label[i] for i in range(1500)]) > 0.99
    assert all(g[2] == (i == g[1]) for i, g in got.items())


@pytest.mark.parametrize("d, used", [(64, 64), (64, 32), (384, 192), (768, 256), (64, "decaying")])
def test_near_vectors_meet_wherever_their_energy_lies(d, used):
    from tidewake.llm.near_vectors import codes, filters_of

    rng = np.random.default_rng(6)
    scale = 0.9 ** np.arange(d) if used == "decaying" else (np.arange(d) < used).astype(float)
    a, b = (rng.standard_normal((150, d)) * scale for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    assert np.mean([len(np.intersect1d(f, g)) > 0 for f, g in zip(filters_of(a, codes(d)), filters_of(b, codes(d)))]) > 0.97


def test_near_vectors_padded_against_all_pairs(spark):
    from tidewake.llm.near_vectors import near_vectors

    rows = np.hstack([clustered(800, 32, 4), np.zeros((800, 32), np.float32)])
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(800), "embedding": list(rows.tolist())}), "vec_id long, embedding array<float>")
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    true = int((unit @ unit.T >= 0.95).sum()) - 800
    assert 0.97 * true <= near_vectors(table).agg(F.sum("n_links")).first()[0] <= true


def test_near_vectors_odd_rows(spark):
    from tidewake.llm.near_vectors import near_vectors

    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]),
            (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (10, [0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0]), (11, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = rows_of(near_vectors(table), "vec_id", "n_links", "component_id", "kept")
    want = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), *[(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, None, 11)]]
    assert got == sorted(want, key=repr)
    assert near_vectors(table.limit(0)).count() == 0


# pipeline ----------------------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline
    from tidewake.session import stage

    docs = documents(spark)
    extra = spark.createDataFrame([(10**7 + (r[0] or 0) if r[0] else None, r[1], "en", r[2], len(r[1] or "")) for r in ODD], docs.schema)
    docs = docs.unionByName(extra)
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(step(spark, kept, SF))
        assert kept.columns == docs.columns and kept.count() > 0
        if name != "mix":
            assert kept.exceptAll(before).count() == 0
        if name == "near_copies":
            sets = [shingles(r["text"]) for r in kept.collect()]
            roots = brute_components(sets, corpus_pipeline.NEAR_PERCENT)
            assert corpus_pipeline.NEAR_PERCENT == 80 and len(set(roots)) == len(roots)
            all_roots = brute_components([shingles(r["text"]) for r in before.collect()], 80)
            assert len(set(all_roots)) == len(roots)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert last.count() == kept.count()


def test_registered_queries_have_their_columns(spark):
    import __spark_entry__

    named = __spark_entry__.queries()
    columns = {
        "op1_": "page_id host path rule verdict", "op2_": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op3_": "doc_id size source_size target taken", "op4_": "doc_id held_out score predicted", "op5_": "doc_id start n_tokens ids_crc32",
        "op6_": "doc_id n_tokens ids_sha256 decoded_sha256", "op7_": "doc_id n_shingles component_id kept",
        "op8_": "doc_id held_out n_tokens n_known train_tokens base_score score", "op9_": "page_id url text n_chars", "op10_": "vec_id n_links component_id kept"}
    for start, want in columns.items():
        name, = (k for k in named if k.startswith(start))
        got = named[name](spark, SF)
        assert got.columns[: len(want.split())] == want.split()
    assert "pipeline" in named
