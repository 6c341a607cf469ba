"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be joined by a merge, so a text is
cut at every such pair and the fragments are encoded independently. Pairs with white space are
of this kind; they cut a text into words, which are kept with their ids in a bounded cache.
Inside a word, the pretokens are cut again at the remaining forced boundaries, so that a merge
never runs over more than a fragment however long the word is. Fragments that end a pretoken
go through the library's own BPE model; fragments inside one go through the same model without
its end-of-word mark. Words, pretokens and fragments are columns throughout: only a fragment
that no cache knows becomes a Python object.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Words and pretokens that a cache keeps (about 40 bytes each, twice that while it grows), and bytes of them and their ids.
CACHE_WORDS = 100_000
CACHE_PRETOKENS = 100_000
CACHE_BYTES = 64 << 20

# The tokenizer's pattern of pretokens, that is these endings, runs of letters, single
# numbers, and runs of what is neither.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
LETTER, NUMBER, OTHER = range(3)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(shown)))
    return [letters[b] for b in range(256)]


class WordEncoder:
    """Encoder of white-space-separated words, equal to the library's on whole texts."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.final = self._model(spec, spec["model"]["end_of_word_suffix"])
        self.inner = self._model(spec, None)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        suffix = spec["model"]["end_of_word_suffix"]
        size = 1 + max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"]))
        self.token = [""] * size
        for token, i in vocab.items():
            self.token[i] = token
        for t in spec["added_tokens"]:
            self.token[t["id"]] = t["content"]
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.letters = byte_letters()
        self.number = np.zeros(1 + max(map(ord, self.letters)), np.uint8)
        self.number[[ord(c) for c in self.letters]] = np.arange(256)
        self.forced = self._forced(vocab, suffix)
        self.byte_code = np.array([ord(c) for c in self.letters], "<u2")
        # words that the short way doesn't take: below U+0250 all printable texts are in NFC
        low = [chr(c) for c in range(0x250)]
        odd = regex.compile(r"[^\x20-\x7e\xa1-\xac\xae-\u024f]")
        self.usual = np.array([not odd.match(c) and len(c.lower()) == 1 and c.lower() <= low[-1] for c in low] + [False])
        self.lower = np.array([ord(c.lower()) if u else 0 for c, u in zip(low, self.usual)], np.uint16)
        self.kind = np.array([LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER for c in low], np.uint8)
        # white space occurs in no token: every pair with it is a forced boundary
        assert all(self.forced[s, :].all() and self.forced[:, s].all() for s in b" \t\n\r\x0b\x0c")

    @staticmethod
    def _model(spec: dict, suffix: str | None) -> Tokenizer:
        """The tokenizer's BPE model alone, with or without its end-of-word mark."""
        model = {**spec["model"], "end_of_word_suffix": suffix}
        bare = {**spec, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "model": model}
        return Tokenizer.from_str(json.dumps(bare))

    def _forced(self, vocab: dict[str, int], suffix: str) -> np.ndarray:
        """256 x 256: pairs of bytes that no vocabulary token holds side by side."""
        forced = np.ones((256, 256), bool)
        bare = [t.removesuffix(suffix) for t in vocab]
        codes, lengths = self._codes("".join(bare)), np.array([len(t) for t in bare])
        inside = np.ones(max(0, len(codes) - 1), bool)
        ends = np.cumsum(lengths)[:-1]
        inside[ends[(ends > 0) & (ends < len(codes))] - 1] = False
        forced[codes[:-1][inside], codes[1:][inside]] = False
        return forced

    def _codes(self, lettered: str) -> np.ndarray:
        """Bytes that a text of byte letters stands for."""
        return self.number[np.frombuffer(lettered.encode("utf-16-le"), np.uint16)]

    def pretokens(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Lower-cased pretokens of all words (UTF-8 bytes, white space in none), one after another,
        and how many each word has; -1 for a word with a special token."""
        offsets, data = _bytes_of(words)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        places = _upto((data & 0xC0) != 0x80)[offsets]  # of each word's first code point
        odd = np.diff(_upto(~self.usual[np.minimum(codes, len(self.lower))])[places]) > 0
        special = np.zeros(len(words), bool)
        for token in self.special:
            special |= np.asarray(pc.match_substring(words, token))
        odd |= special
        if not odd.any():
            return self._short_way(codes, places)
        usual = np.flatnonzero(~odd)
        sizes = np.diff(places)
        counts = np.full(len(words), -1)
        inside, counts[usual] = self._short_way(codes[np.repeat(~odd, sizes)], _upto(sizes[usual]))
        rows = np.flatnonzero(odd & ~special)
        split = [self._long_way(word.decode()) for word in words.take(pa.array(rows)).to_pylist()]
        counts[rows] = list(map(len, split))
        # the usual words' pretokens stand first
        known = counts >= 0
        starts = np.zeros(len(words), np.int64)
        order = np.concatenate((usual, rows))
        starts[order] = _upto(counts[order])[:-1]
        both = pa.concat_arrays([inside, pa.array(list(chain.from_iterable(split)), pa.large_binary())])
        return both.take(pa.array(_spans(starts[known], counts[known])[0])), counts

    def _short_way(self, codes: np.ndarray, places: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Pretokens of words whose code points are usual ones, by the pattern's rules."""
        codes = self.lower[codes]
        n, kind = len(codes), self.kind[codes]
        begins = np.zeros(n + 1, bool)
        begins[places] = True
        starts = begins.copy()
        starts[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        marks = np.flatnonzero((codes == ord("'")) & starts[:n])
        if len(marks):
            ahead = np.append(codes, (0, 0))
            first, second = ahead[marks + 1], ahead[marks + 2]
            one, two = ~begins[marks + 1], ~begins[marks + 1] & ~begins[np.minimum(marks + 2, n)]
            for ending in ENDINGS:
                fits = one & (first == ord(ending[1])) if len(ending) == 2 else two & (first == ord(ending[1])) & (second == ord(ending[2]))
                starts[marks[fits] + 1] = False
                starts[marks[fits] + len(ending)] = True
        starts[n] = True
        bounds = np.flatnonzero(starts)
        data = codes.astype("<u2").tobytes().decode("utf-16-le").encode()
        offsets = _upto(1 + (codes >= 0x80))[bounds]
        return _binary(offsets, data), np.diff(np.searchsorted(bounds, places))

    def _long_way(self, text: str) -> list[bytes]:
        lettered = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))
        return [self._codes(p).tobytes() for p, _ in lettered]

    def encode_pretokens(self, pretokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pretokens (bytes) one after another, and how many each has."""
        offsets, data = _bytes_of(pretokens)
        final = np.zeros(len(data), bool)
        final[offsets[1:] - 1] = True
        cut = final.copy()
        cut[:-1] |= self.forced[data[:-1], data[1:]]
        stops = np.flatnonzero(cut)
        closing = final[stops]
        fragments = _binary(np.append(0, stops + 1), data)
        sizes, starts, found, size = np.zeros(len(stops), np.int64), np.zeros(len(stops), np.int64), [], 0
        for closes, model in ((True, self.final), (False, self.inner)):
            own = np.flatnonzero(closing == closes)
            distinct = fragments.take(pa.array(own)).dictionary_encode()
            ids, lengths = self._model_ids(model, distinct.dictionary)
            index = np.asarray(distinct.indices)
            sizes[own], starts[own] = lengths[index], (size + _upto(lengths)[:-1])[index]
            found.append(ids)
            size += len(ids)
        places, upto = _spans(starts, sizes)
        return np.concatenate(found)[places], np.diff(upto[np.append(0, np.flatnonzero(closing) + 1)])

    def _model_ids(self, model: Tokenizer, fragments: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets, data = _bytes_of(fragments)
        lettered, tokenize = self.byte_code[data].tobytes().decode("utf-16-le"), model.model.tokenize
        ids, sizes = [], []
        for a, b in pairwise(offsets.tolist()):
            tokens = tokenize(lettered[a:b])
            ids += [t.id for t in tokens]
            sizes.append(len(tokens))
        return np.array(ids, self.dtype), np.array(sizes, np.int64)


def _upto(sizes: np.ndarray) -> np.ndarray:
    """Sums of all sizes before each place, from 0 to their end."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _spans(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of spans one after another, and where each begins among them."""
    upto = _upto(sizes)
    small = np.int32 if max(upto[-1], starts.max(initial=0)) < 1 << 30 else np.int64
    places = np.repeat((starts - upto[:-1]).astype(small), sizes)
    places += np.arange(upto[-1], dtype=small)
    return places, upto


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a large binary column without NULL."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def _binary(offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


class Recent:
    """Cache of two generations: a full one becomes the old one, and what is used again moves on, so
    that frequent keys stay and memory is bounded."""

    def __init__(self, size: int):
        self.size, self.now, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """Keys that neither generation holds; all others are in ``now`` afterwards."""
        if len(self.now) > self.size:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        absent = keys.difference(now)
        again = absent.intersection(old)
        now.update(zip(again, map(old.__getitem__, again)))
        return list(absent.difference(again))


    def values(self, keys: list) -> list:
        """Value of each key, None where neither generation holds it; those of the old one move on."""
        if len(self.now) > self.size:
            self.now, self.old = {}, self.now
        found = list(map(self.now.get, keys))
        if self.old:
            for i, value in enumerate(found):
                if value is None and (value := self.old.get(keys[i])) is not None:
                    found[i] = self.now[keys[i]] = value
        return found


class KnownIds:
    """The ids of distinct keys, those used last kept as columns: ``size`` keys at most, ``CACHE_BYTES``
    of them and their ids."""

    def __init__(self, size: int, learn: Callable, dtype: np.dtype):
        self.size, self.learn, self.calls = size, learn, 0
        self.keys, self.ids = pa.array([], pa.large_binary()), np.zeros(0, dtype)
        self.starts = self.sizes = self.used = np.zeros(0, np.int64)

    def of(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each of the keys (no key twice) where its own begin and how many they are."""
        place = pc.index_in(keys, self.keys)
        absent = np.asarray(place.is_null())
        place = np.asarray(place.fill_null(0), np.int64)
        if absent.any():
            new = keys.filter(pa.array(absent))
            ids, sizes = self.learn(new)
            place[absent] = len(self.keys) + np.arange(len(new))
            self.starts = np.append(self.starts, len(self.ids) + _upto(sizes)[:-1])
            self.sizes, self.ids = np.append(self.sizes, sizes), np.append(self.ids, ids)
            self.keys, self.used = pa.concat_arrays([self.keys, new]), np.append(self.used, np.zeros(len(new), np.int64))
        self.calls += 1
        self.used[place] = self.calls
        found = self.ids, self.starts[place], self.sizes[place]
        if len(self.keys) > self.size or self.keys.nbytes + self.ids.nbytes > CACHE_BYTES:
            self._forget()
        return found

    def _forget(self):
        recent = np.argsort(-self.used, kind="stable")[: self.size // 2]
        volume = np.asarray(pc.binary_length(self.keys))[recent] + self.sizes[recent] * self.ids.itemsize
        kept = np.sort(recent[np.cumsum(volume) <= CACHE_BYTES // 2])
        places, upto = _spans(self.starts[kept], self.sizes[kept])
        self.keys, self.ids, self.starts = self.keys.take(pa.array(kept)), self.ids[places], upto[:-1]
        self.sizes, self.used = self.sizes[kept], self.used[kept]


class EncodedWords:
    """Bounded caches from words and pretokens to their ids. Texts are split and their words made
    distinct by Arrow; no word is a Python object."""

    def __init__(self, encoder: WordEncoder):
        self.encoder = encoder
        self.words = KnownIds(CACHE_WORDS, self._learn, encoder.dtype)
        self.parts = KnownIds(CACHE_PRETOKENS, encoder.encode_pretokens, encoder.dtype)

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pretokens, counts = self.encoder.pretokens(words)
        distinct = pretokens.dictionary_encode()
        ids, starts, sizes = self.parts.of(distinct.dictionary)
        index = np.asarray(distinct.indices)
        places, upto = _spans(starts[index], sizes[index])
        ids = ids[places]
        upto = upto[_upto(np.maximum(counts, 0))]
        special = np.flatnonzero(counts < 0)
        if not len(special):
            return ids, np.diff(upto)
        sizes, whole = np.diff(upto), [self.encoder.whole.encode(words[i].as_py().decode(), add_special_tokens=False).ids for i in special.tolist()]
        ids = np.insert(ids, np.repeat(upto[special], list(map(len, whole))), np.array(list(chain.from_iterable(whole)), ids.dtype))
        sizes[special] = list(map(len, whole))
        return ids, sizes

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes, no NULL) one after another, and the n + 1 places where each
        text's begin."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids, starts, sizes = self.words.of(words.dictionary.cast(pa.large_binary()))
        index = np.asarray(words.indices)
        places, upto = _spans(starts[index], sizes[index])
        return ids[places], upto[np.asarray(split.offsets, np.int64)]

    def of(self, texts: list[bytes]) -> list[list[list[int]]]:
        """For each text its ids, in one list."""
        ids, ends = self.ids(pa.array(texts, pa.large_binary()))
        return [[ids[a:b].tolist()] for a, b in pairwise(ends.tolist())]


def ids_only(encoder: WordEncoder) -> EncodedWords:
    return EncodedWords(encoder)


def decoded(encoder: WordEncoder, ids) -> str:
    """The library's decode() of a tokenizer without a decoder: tokens joined by a space."""
    return " ".join(map(encoder.token.__getitem__, ids))
