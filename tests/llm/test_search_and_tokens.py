"""Ranked search, rank-file BPE and token alignment against brute force and the libraries."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest

SF = "/root/testdata/sf0.001"
CJK = "".join(map(chr, (0x65E5, 0x672C, 0x8A9E)))
#: id, text, a further column: nulls, empty and long texts, ties, repeated rows, ids that repeat.
ODD = [
    (1, "One two three, the FOUR five", "b"), (2, "one TWO three the four five", "a"), (3, None, None), (4, "", "a"),
    (5, " \n\t ", "a"), (6, "word", "a"), (7, "Word", None), (8, "x" * 50_000, "b"), (9, "lorem ipsum dolor sit amet, " * 4000, "b"),
    (9, "lorem ipsum dolor sit amet, " * 4000, "b"), (10, f"né à don't STOP 12 ½ <|endoftext|> <s> {CJK}。{CJK}", "c"),
    (None, "no id at all one", "c"), (None, None, None), (11, "a b\x1cc\x00d ▁ e", "c"), (12, "one two three the four five", "b"),
    (13, "a" + " " * 5000 + "b" + "\n " * 3000, "b"), (14, " " * 9000, "b"), (15, "tab\there  two   spaces \U0001F642", "b"),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, n long" if not rows else "doc_id long, text string, n string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 11 ----------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top):
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=repr)


ITEMS = [(1, "One two, the"), (1, "FIVE five"), (2, "nothing-like-it lorem"), (3, None), (4, "..."), (None, "word no"), (5, f"{CJK} né a b c")]


@pytest.mark.parametrize("block_terms", [1 << 18, 3])
def test_ranked_search_against_brute_force(spark, block_terms):
    from tidewake.llm.bag_ranking import rank_documents

    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for top in (2, 10):
        got = rows_of(rank_documents(frame(spark), items, top, block_terms), "item_id", "rank", "doc_id", "score")
        assert got == ranked([(d, t) for d, t, _ in ODD], ITEMS, top)


def test_ranked_search_of_documents_and_many_copies(spark):
    from tidewake.llm import bag_ranking

    docs = [tuple(r) for r in documents(spark).collect()]
    docs += [(10_000 + i, docs[3][1]) for i in range(300)]  # a class much larger than what is shown
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items.append((900, docs[3][1]))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = rows_of(bag_ranking.rank_documents(table, spark.createDataFrame(items, "item_id long, text string")), "item_id", "rank", "doc_id", "score")
    assert got == ranked(docs, items, 10)


def test_ranked_search_of_empty_tables(spark):
    from tidewake.llm.bag_ranking import rank_documents

    none, items = frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rank_documents(none, items).collect() == []
    assert rank_documents(frame(spark), items.where("false")).collect() == []
    assert rank_documents(frame(spark, [(1, None, None), (2, "", None)]), items).collect() == []


# 12 ----------------------------------------------------------------------------------------------
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    from tidewake.llm.rank_codec import RankCodec

    return RankCodec(RANKS, public_tokenizers.PATTERN)


def matches(text):
    """The pattern's matches, found by another library."""
    import regex

    white = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    pattern = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{white}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{white}]").replace(r"\s", rf"[{white}]")
    return [m.group() for m in regex.finditer(pattern, text)]


def by_matches(codec, text):
    return [i for m in matches(text) for i in codec.library._encode_single_piece(m)]


def test_rank_codec_against_matches_and_round_trip(spark, codec):
    from tidewake.llm.rank_codec import encode_decode

    table = frame(spark).unionAll(documents(spark).selectExpr("doc_id + 1000", "text", "'x'"))
    got = encode_decode(table, RANKS, public_tokenizers.PATTERN, ids=True, decoded=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    result = defaultdict(list)
    for r in got.collect():
        result[r["doc_id"]].append(r)
    wanted = defaultdict(list)
    for d, text, _ in table.collect():
        wanted[d].append(text or "")
    assert {d: len(t) for d, t in wanted.items()} == {d: len(r) for d, r in result.items()}
    for d, texts in wanted.items():
        want = []
        for text in texts:
            ids = by_matches(codec, text)
            want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text.encode()))
        assert sorted(want) == sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"], bytes(r["decoded"])) for r in result[d])
    assert encode_decode(frame(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_rank_codec_pieces_join_to_the_whole(codec):
    rng = random.Random(3)
    parts = ["the", "'s", "'", " ", "  ", "\n", " ", "12", "3", ",", "...", "été", CJK, "。", "\x1c", "x" * 30, " " * 2500, "\t\n" * 1300, "\U0001F642"]
    for _ in range(150):
        text = "".join(rng.choices(parts, [8] * 16 + [1, 1, 4], k=rng.randint(0, 60)))
        whole = by_matches(codec, text)
        for piece in (1, 7, 100, 1 << 16):
            assert [i for p in codec.pieces(text, piece) for i in p.tolist()] == whole, (text, piece)


# 13 ----------------------------------------------------------------------------------------------
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligned_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    from tidewake.llm.bpe import byte_letters

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_letters())}

    def content_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def one(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [content_b(i) for i in ids_b]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return None
        def stops(parts):
            return [sum(map(len, parts[: k + 1])) for k in range(len(parts))] if len(parts) < 500 else _running(parts)
        ends_a, ends_b = stops(bytes_a), stops(bytes_b)
        both = sorted(set(ends_a) & set(ends_b))
        groups, x, y = [], 0, 0
        for end in both:
            ga, gb = [], []
            while x < len(ids_a) and ends_a[x] <= end:
                ga.append(ids_a[x])
                x += 1
            while y < len(ids_b) and ends_b[y] <= end:
                gb.append(ids_b[y])
                y += 1
            groups.append((ga, gb))
        links = Counter()
        for ga, gb in groups:
            for i, n in Counter(ga).items():
                for j, m in Counter(gb).items():
                    links[i, j] += n * m
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        return len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(text.encode()).hexdigest()

    found = [one(t) if t else None for _, t in rows]
    counts = Counter(p for f in found if f for p in f[3])
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for (d, _), f in zip(rows, found):
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            links = f[3]
            out.append((d, *f[:3], sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]),
                        sum(n * counts[p] for p, n in links.items()), f[4]))
    return sorted(out, key=repr)


def _running(parts):
    out, at = [], 0
    for p in parts:
        at += len(p)
        out.append(at)
    return out


MEASURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("held", [1 << 19, 40, 0])
def test_token_alignment_against_brute_force(spark, held):
    from tidewake.llm.token_alignment import align_documents

    docs = [(d, t) for d, t, _ in ODD if t is None or len(t) < 60_000]
    docs += [tuple(r) for r in documents(spark).where("length(text) < 4000").collect()]
    docs += [(5000 + i, docs[0][1]) for i in range(40)]
    docs += [(5100, "the cat, " * 9000), (5101, "▁"), (5102, " lead"), (5103, "trail "), (5104, "İﬁ x")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS n_a", "2 AS copies")
    got = align_documents(table, A_PATH, B_PATH, held)
    assert tuple(got.columns) == MEASURES
    assert rows_of(got, *MEASURES) == aligned_by_hand(docs)


def test_token_alignment_in_small_blocks(monkeypatch):
    from tidewake.llm import token_alignment as ta

    aligner = ta.Aligner(A_PATH, B_PATH)
    texts = ["one two three " * 30, f"{CJK} {CJK}。 née   x", "x" * 700 + " y", "", " "]
    whole = aligner.align(texts)
    monkeypatch.setattr(ta, "LINKS", 3)
    for a, b in zip(whole, aligner.align(texts)):
        assert (a is None) == (b is None)
        if a is not None:
            assert a.groups == b.groups and a.pairs.tolist() == b.pairs.tolist() and a.links.tolist() == b.links.tolist()
    # a text cut at spaces has the measures of the whole
    text = ("one two, three! " * 40).strip()
    together = ta._Measures()
    for piece in ta.cut(text, 25):
        together.add(aligner.align([piece])[0])
    at_once = ta._Measures()
    at_once.add(aligner.align([text])[0])
    assert len(list(ta.cut(text, 25))) > 10
    assert together.hash.hexdigest() == at_once.hash.hexdigest() and together.counts.tolist() == at_once.counts.tolist()
    assert [x.tolist() for x in together.pairs()] == [x.tolist() for x in at_once.pairs()]


def test_token_alignment_of_empty_tables(spark):
    from tidewake.llm.token_alignment import align_documents

    assert align_documents(frame(spark, []), A_PATH, B_PATH).collect() == []
    assert rows_of(align_documents(frame(spark, [(1, None, None), (2, "", None)]), A_PATH, B_PATH), "doc_id", "n_links") == [(1, 0), (2, 0)]
