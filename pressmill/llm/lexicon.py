"""BPE by a minimal acyclic transducer of frequent words, with exact merges for all others."""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, columns_of, filesystem, shared_dir, text_batches
from .tokens import byte_alphabet

#: Words compiled into the transducer: the most frequent ones of the whole corpus.
LEXICON_WORDS = 50_000
#: Words that a worker remembers, and characters of what they give; past either, it forgets all.
MEMORY_LIMIT, MEMORY_CHARS = 450_000, 32_000_000
#: Documents looked up together, and characters of theirs.
_GROUP, _GROUP_CHARS = 256, 4_000_000
#: Words of more bytes are merged one by one with a heap of pairs, shorter ones in step.
_HEAP = 48
#: Characters that are looked at in advance, whether a whole text of them can be cut at once: no marks, which join with others.
_LOOKED_AT = [*range(1, 0x250), *range(0x386, 0x483), *range(0x48A, 0x530), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0), *range(0x3001, 0x3029), *range(0x3041, 0x3097)]
#: White space of Unicode, as the vocabulary file's patterns see it.
_SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_OTHER_SPLITS = "\x1c\x1d\x1e\x1f"


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words, with their ids, as one flat file.

    Words are added in order; the part of the last word that the next one
    does not share is final then, and each of its states is replaced by an
    equal one known before (same ends, same edges), so suffixes are shared.
    An edge carries the number of words that sort before those past it, so a word's
    edges sum to its ordinal, which finds its ids.
    """
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # (ends a word, ((byte, state), ...)), final ones

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[list] = [[False, []]]  # open states of the last word: [ends, edges]
    last = b""
    for word in sorted(entries):
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        while len(path) > common + 1:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(done)))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(done)))
    root = settle(path[0])
    words_from = np.zeros(len(states), np.int64)
    keys, targets, skips = [], [], []
    for k, (ends, edges) in enumerate(states):  # an edge's state always comes before
        before = int(ends)
        for byte, to in edges:
            keys.append(k << 8 | byte)
            targets.append(to)
            skips.append(before)
            before += int(words_from[to])
        words_from[k] = before
    ids = [entries[w] for w in sorted(entries)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i8")
    flat = np.array([i for x in ids for i in x], "<i8")
    parts = [np.array(keys, "<i8"), np.array(targets, "<i8"), np.array(skips, "<i8"), np.array([e for e, _ in states], "<i8"), offsets, flat]
    head = np.array([root, *(len(p) for p in parts)], "<i8")
    return b"".join(p.tobytes() for p in [head, *parts])


class Transducer:
    """Looks words up in a compiled file, which may be a memory map; many words advance in step."""

    def __init__(self, source):
        data = np.frombuffer(source, "<i8")
        root, *sizes = data[:7].tolist()
        at, parts = 7, []
        for n in sizes:
            parts.append(data[at : at + n])
            at += n
        self.root = root
        self.keys, self.targets, self.skips, self.ends, self.offsets, self.ids = parts

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """Each word's ordinal; -1 where it is not in the lexicon."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, ordinal = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        live, depth = np.arange(len(words)), 0
        while len(live) and len(self.keys):
            live = live[size[live] > depth]
            if not len(live):
                break
            key = state[live] << 8 | data[begin[live] + depth]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            ordinal[live[~hit]] = -1
            live, spot = live[hit], spot[hit]
            ordinal[live] += self.skips[spot]
            state[live] = self.targets[spot]
            depth += 1
        if not len(self.keys):
            ordinal[size > 0] = -1
        reached = ordinal >= 0
        ordinal[reached & (self.ends[state] == 0)] = -1
        return ordinal

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        return [None if k < 0 else self.ids[self.offsets[k] : self.offsets[k + 1]].tolist() for k in self.ordinals(words).tolist()]


class Merges:
    """The ranks and results of pairs of symbols in an open hash table, so that many words are merged in step."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        first, second, made = (np.array([vocab[m] for m in column], np.int64) for column in (*zip(*merges), [a + b for a, b in merges]))
        self.none, self.made = np.int32(len(merges)), np.append(made, -1).astype(np.int32)
        self.bits = max(4, int(4 * len(merges)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.none, np.int32)
        keys = first << 32 | second
        slots, self.reach = self._slots(keys), 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots.tolist())):
            step = 0
            while self.keys[(slot + step) & (len(self.keys) - 1)] not in (-1, key):
                step += 1
            at = (slot + step) & (len(self.keys) - 1)
            self.keys[at], self.ranks[at] = key, rank  # of a pair given twice the last rank counts
            self.reach = max(self.reach, step + 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``none`` where it is not merged, or one of the two is no symbol (-1)."""
        keys = a.astype(np.int64) << 32 | b  # -1 on either side gives a negative key, which no pair has
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.ranks[slots], self.none)
        open_ = np.nonzero((held != keys) & (held != -1))
        for _ in range(1, self.reach):
            if not len(open_[0]):
                break
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            held, own = self.keys[slots[open_]], keys[open_]
            found[open_] = np.where(held == own, self.ranks[slots[open_]], self.none)
            left = (held != own) & (held != -1)
            open_ = tuple(x[left] for x in open_)
        return found

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols (-1 past the end), merged as far as they go: the least rank first, leftmost first."""
        out, live = symbols.copy(), np.arange(len(symbols))
        held, width = symbols.copy(), symbols.shape[1]
        if width < 2:
            return out
        ranks = self.rank(held[:, :-1], held[:, 1:])
        place = np.arange(width)
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(live)), at]
            goes_on = least < self.none
            if not goes_on.all():
                out[live[~goes_on]] = held[~goes_on]
                live, held, ranks, at, least = live[goes_on], held[goes_on], ranks[goes_on], at[goes_on], least[goes_on]
            if not len(live):
                return out
            row = np.arange(len(live))
            # the right one of the pair goes, and all after it move up
            source = np.minimum(place + (place > at[:, None]), width - 1)
            held = np.take_along_axis(held, source, 1)
            held[:, -1] = -1
            held[row, at] = self.made[least]
            ranks = np.take_along_axis(ranks, np.minimum(source[:, :-1], width - 2), 1)
            ranks[:, -1] = self.none
            inner = at < width - 1
            ranks[row[inner], at[inner]] = self.rank(held[row[inner], at[inner]], held[row[inner], at[inner] + 1])
            inner = at > 0
            ranks[row[inner], at[inner] - 1] = self.rank(held[row[inner], at[inner] - 1], held[row[inner], at[inner]])


class WordBpe:
    """What the vocabulary file says: normalised words, merges by rank, ids and their tokens.

    Pieces with characters beyond ASCII are normalised and cut into words by the tokenizers library
    itself, whose Unicode tables are of another age than those of Python and its packages.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        codec = Tokenizer.from_file(path)
        self.normal, self.cut = codec.normalizer.normalize_str, codec.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.end = model["end_of_word_suffix"] or ""
        self.merges = Merges(self.vocab, merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.symbol = {b: c for c, b in byte_alphabet().items()}
        self.inside, self.last = (np.array([self.vocab[self.symbol[b] + end] for b in range(256)], np.int32) for end in ("", self.end))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        fine = [chr(c) for c in _LOOKED_AT if self._agrees(chr(c))]
        kind = lambda pattern: re.escape("".join(c for c in {x.lower() for x in fine} if regex.fullmatch(pattern, c)))
        letters, numbers, spaces = kind(r"\p{L}"), kind(r"\p{N}"), kind(r"\s")
        #: Texts of such characters alone, and their words once they are in lower case.
        self.plain = re.compile(f"[{re.escape(''.join(fine))}]*").fullmatch
        self.plain_words = re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{spaces}{letters}{numbers}]+").findall
        self.ascii_words = re.compile("[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^ \t\n\x0b\x0c\ra-z0-9]+").findall

    def _agrees(self, c: str) -> bool:
        """Whether Python and the pattern make of a character what the library does, beside letters, digits, marks and itself."""
        text = f"x{c}x 1{c}{c}1 .{c}. '{c}' {c}"
        low = self.normal(text)
        return c != chr(0x3A3) and len(c.lower()) == 1 and [low[a:b] for _, (a, b) in self.cut(low)] == self.words.findall(text.lower())

    def words_of(self, text: str | None) -> list[str | int]:
        """The normalised words of a whole text, and the ids of special tokens in it."""
        if not text:
            return []
        if "<|" not in text:
            if text.isascii():
                return self.ascii_words(text.lower())
            if self.plain(text):
                return self.plain_words(text.lower())
        return [w for piece in pieces_of(text) for w in self.parts(piece)]

    def parts(self, piece: str) -> list[str | int]:
        """Words of a piece without white space, and the ids of special tokens in it."""
        found: list[str | int] = []
        for part in self.specials.split(piece) if "<|" in piece else (piece,):
            if part in self.special:
                found.append(self.special[part])
            elif part.isascii():
                found += self.ascii_words(part.lower())
            else:
                part = self.normal(part)
                found += [part[a:b] for _, (a, b) in self.cut(part)]
        return found

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word: the pair of least rank is joined, leftmost first, until none is left.

        Words of similar lengths are merged in step.
        """
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(size > _HEAP).tolist():
            out[k] = self.merge_long(words[k])
        for low, high in ((0, 6), (6, 9), (9, 13), (13, 20), (20, _HEAP)):
            own = np.flatnonzero((size > low) & (size <= high))
            if not len(own):
                continue
            chosen, n = [words[k] for k in own.tolist()], size[own]
            data = np.frombuffer(b"".join(chosen), np.uint8)
            row, begin = np.repeat(np.arange(len(own)), n), np.cumsum(n) - n
            symbols = np.full((len(own), int(n.max())), -1, np.int32)
            symbols[row, np.arange(len(data)) - begin[row]] = self.inside[data]
            symbols[np.arange(len(own)), n - 1] = self.last[data[begin + n - 1]]
            merged = self.merges.merge(symbols)
            for k, ids, left in zip(own.tolist(), merged.tolist(), (merged >= 0).sum(1).tolist()):
                out[k] = ids[:left]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """As merge, of one word in n log n: a heap of (rank, place) of neighbouring pairs, the places linked both ways."""
        symbols: list[str | None] = [self.symbol[b] for b in word]
        symbols[-1] += self.end
        n, rank = len(symbols), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if j >= n or symbols[k] is None or rank.get((symbols[k], symbols[j])) != r:
                continue  # one of the two has been joined to another since
            symbols[k], symbols[j] = symbols[k] + symbols[j], None
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (r := rank.get((symbols[k], symbols[j]))) is not None:
                    heapq.heappush(heap, (r, k))
            i = before[k]
            if i >= 0 and (r := rank.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        return [self.vocab[s] for s in symbols if s in self.vocab]


@functools.lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(2)
def open_lexicon(uri: str) -> Transducer:
    """The shared file, mapped where the shared folder is a mounted one."""
    from pyarrow import fs

    store, path = filesystem(uri)
    if isinstance(store, fs.LocalFileSystem):
        return Transducer(np.memmap(path, np.uint8, mode="r"))
    return Transducer(store.open_input_file(path).read())


def pieces_of(text: str | None) -> list[str]:
    """The runs of a text without white space; merges and normalisation never cross them."""
    if not text:
        return []
    if any(c in text for c in _OTHER_SPLITS):  # split() takes these for white space; the patterns don't
        table = str.maketrans(dict.fromkeys(_SPACES, " "))
        return [p for p in text.translate(table).split(" ") if p]
    return text.split()


class Encoder:
    """Ids and tokens of texts: words from memory, new ones by the transducer or by merging."""

    def __init__(self, vocabulary: str, lexicon: str):
        self.bpe, self.lexicon = word_bpe(vocabulary), open_lexicon(lexicon)
        self.names = {i: str(i) for i in self.bpe.token}
        #: (decimal ids, tokens) of words.
        self.words: dict[str | int, tuple[str, str]] = {}
        self.chars = 0

    def learn(self, texts: list[list[str | int]]) -> None:
        seen: set[str | int] = set()
        for words in texts:
            seen.update(words)
        new = seen - self.words.keys()
        if len(self.words) + len(new) > MEMORY_LIMIT or self.chars > MEMORY_CHARS:
            self.words.clear()
            self.chars = 0
            new = seen
        special = [w for w in new if w.__class__ is int]
        new.difference_update(special)
        words = list(new)
        packed = [w.encode() for w in words]
        ids = self.lexicon.find(packed)
        unseen = [k for k, found in enumerate(ids) if found is None]
        for k, found in zip(unseen, self.bpe.merge([packed[k] for k in unseen])):
            ids[k] = found
        name, token, chars = self.names, self.bpe.token, 0
        for word, own in zip([*words, *special], [*ids, *([i] for i in special)]):
            self.words[word] = a, b = " ".join([name[i] for i in own]), " ".join([token[i] for i in own])
            chars += len(a) + len(b)
        self.chars += chars

    def encode(self, words: list[str | int]) -> tuple[str, str]:
        """(decimal ids, decoded text), each joined by one space, of words learnt before."""
        if not words:
            return "", ""
        ids, tokens = zip(*map(self.words.__getitem__, words))
        return " ".join(ids), " ".join(tokens)


@functools.lru_cache(2)
def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    return Encoder(vocabulary, lexicon)


def frequent_words(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts, ``most`` at most, counted in tasks and then summed."""
    text_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        words: Counter = Counter()
        held = 0

        def tell() -> pa.RecordBatch:
            own = [w for w in words if w.__class__ is str]
            rows = [pa.array(own, pa.string()).cast(pa.binary()), pa.array([words[w] for w in own], pa.int64())]
            words.clear()
            return pa.RecordBatch.from_arrays(rows, names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                words.update(bpe.words_of(text))
                held += len(text)
                if len(words) > MEMORY_LIMIT or held > MEMORY_CHARS:
                    held = 0
                    yield tell()
        yield tell()

    counts = checkpoint(columns_of(docs, "text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # whole classes of equal frequency (16 to a doubling) from the top, so that no task sends a list of its own
    level = F.floor(F.log2("n") * 16).cast("int")
    total, lowest = 0, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred rows
        total += r["count"]
        if total > most:
            break
        lowest = r["level"]
    if lowest is None:
        return []
    return sorted(bytes(r["word"]) for r in counts.filter(level >= lowest).select("word").collect())


def build_lexicon(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> str:
    """Compile the frequent words on the driver and write the file to the shared folder; its URI.

    ``most`` words and their ids, a few MB, are all that the driver handles.
    """
    bpe = word_bpe(vocabulary)
    words = frequent_words(docs, vocabulary, most)
    data = compile_words(dict(zip(words, bpe.merge(words))))
    uri = f"{shared_dir(docs.sparkSession).rstrip('/')}/lexicon-{uuid.uuid4().hex}.bin"
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)
    return uri


def encoded(texts: Iterable[str | None], vocabulary: str, lexicon: str) -> Iterator[tuple[str, str]]:
    """(decimal ids, decoded text) of each text.

    Meanwhile no cycles are collected: none are made, and the memories would be gone through again and again.
    """
    collects = gc.isenabled()
    gc.disable()
    try:
        yield from _encoded(texts, _encoder(vocabulary, lexicon))
    finally:
        if collects:
            gc.enable()


def _encoded(texts: Iterable[str | None], encoder: Encoder) -> Iterator[tuple[str, str]]:
    group: list[list[str]] = []
    chars = 0
    for text in texts:
        group.append(encoder.bpe.words_of(text))
        chars += len(text or "")
        if len(group) == _GROUP or chars > _GROUP_CHARS:
            encoder.learn(group)
            yield from map(encoder.encode, group)
            group, chars = [], 0
    encoder.learn(group)
    yield from map(encoder.encode, group)


def bpe_digest(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs(doc_id, text)``.

    Null, empty and blank texts have no ids and the digests of no bytes. Rows
    are taken as they are, repeated and null doc_ids too; other columns are ignored; an empty
    table gives no rows. Encoding is one pass without a shuffle, after one that counts words.
    """
    lexicon = build_lexicon(docs, vocabulary, most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            found = [(ids.count(" ") + bool(ids), sha(ids), sha(tokens)) for ids, tokens in encoded(texts, vocabulary, lexicon)]
            n, a, b = zip(*found) if found else ([], [], [])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, vocabulary: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids) with the ids themselves, for use beyond digests."""
    lexicon = build_lexicon(docs, vocabulary, most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [list(map(int, x.split())) for x, _ in encoded((t.as_py() for t in batch.column(1)), vocabulary, lexicon)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, ids array<int>")
