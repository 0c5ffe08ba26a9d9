"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Words are counted over all documents. The most frequent ones are encoded once and compiled into a
minimal acyclic automaton: words that end alike share states, and each transition carries the number
of words that sort before it, so that the sum along a path is the word's place in the list of id
outputs. The automaton is one file of plain arrays in the shared folder, which workers memory-map.
Words outside it are merged exactly, lowest rank first, leftmost first.

Text is prepared as the vocabulary file says: NFC, white space to one space, lower case by character,
words by its pattern, bytes as characters, and the end-of-word suffix. Added tokens in a raw text are
taken out first. Decoding joins the tokens of the ids with single spaces, as the file has no decoder.

Defined cases: null texts are empty and give no ids; repeated rows are encoded each by itself; ties
in frequency go to the word that sorts first; extra columns, whatever their names, are passed by.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.common import emit, pieces, texts, tidy
from twinsieve.llm.files import committed, open_fs
from twinsieve.session import new_path, ship_package

#: Fixed: the white space of the vocabulary file's patterns.
SPACES = "\t-\r \x85\xa0  -     　"
SPACE_RUN = re.compile(f"[{SPACES}]+")
#: Texts of these characters split at white space as str.split does, and are in NFC once normalised.
PLAIN = re.compile("[^\x00-\x1b -įı-˿]")
CACHE = 350_000  # chunks that a worker remembers
HELD = 200_000  # distinct chunks that a task counts before it sends them on
STEP_BYTES = 2 << 20  # bytes of text that are cut into chunks at once; a longer text stays whole
CACHED_CHARS = 64  # longer chunks are not remembered


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


def chunks(text: str) -> list[str]:
    """The prepared text, cut at white space."""
    if not PLAIN.search(text):
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.lower().split()
    text = unicodedata.normalize("NFC", text)
    # Lower case by character: no final sigma.
    text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return [c for c in SPACE_RUN.split(text) if c]


class Vocabulary:
    """What a vocabulary file of BPE with word ends holds, and exact merging by it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in data["added_tokens"]}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.added_pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", SPACES))
        stand_in = byte_characters()
        self.inner = [ids[stand_in[b]] for b in range(256)]
        self.last = [ids[stand_in[b] + self.suffix] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        pairs = sorted((a << 20 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self._pairs, self._ranks, self._news = np.array(pairs or [(-1, 0, 0)], np.int64).T.copy()
        self._inner, self._last = np.array(self.inner, np.int64), np.array(self.last, np.int64)

    def words(self, chunk: str) -> list[str]:
        return self.pattern.findall(chunk)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by exact merging."""
        symbols = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(symbols) > 48:
            return self._merge_long(symbols)
        merges, none = self.merges, (1 << 60, 0)
        found = [merges.get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            symbols[i:i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = merges.get((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = merges.get((symbols[i], symbols[i + 1]), none)
        return symbols

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers.

        All words merge at once, one pair each a round: the pair of lowest rank, the leftmost of those.
        """
        short = [i for i, w in enumerate(words) if len(w) <= 256]
        out = [b""] * len(words)
        for i, w in enumerate(words):
            if len(w) > 256:
                out[i] = np.array(self.merge(w), "<u4").tobytes()
        if not short:
            return out
        lengths = np.array([len(words[i]) for i in short])
        text = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        symbols = self._inner[text]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self._last[text[ends - 1]]
        owner = np.repeat(np.array(short), lengths)
        none = np.int64(1 << 30)

        def ranks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank and result of the pairs that begin at ``at``."""
            inside = at + 1 < len(symbols)
            right = np.minimum(at + 1, len(symbols) - 1)
            key = symbols[at] << 20 | symbols[right]
            place = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            known = inside & (owner[at] == owner[right]) & (self._pairs[place] == key)
            return np.where(known, self._ranks[place], none), self._news[place]

        rank, new = ranks(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            live = best >> 32 < none
            if not live.all():
                sizes = np.diff(np.append(starts, len(symbols)))
                data = symbols.astype("<u4")
                for k in np.flatnonzero(~live):
                    out[owner[starts[k]]] = data[starts[k]:starts[k] + sizes[k]].tobytes()
                stay = np.repeat(live, sizes)
                moved = np.cumsum(stay) - 1
                at = moved[best[live] & 0xFFFFFFFF]
                symbols, owner, rank, new = symbols[stay], owner[stay], rank[stay], new[stay]
            else:
                at = best & 0xFFFFFFFF
            if not len(symbols):
                break
            symbols[at] = new[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            symbols, owner, rank, new = symbols[stay], owner[stay], rank[stay], new[stay]
            touched = np.concatenate((at, at[at > 0] - 1))
            rank[touched], new[touched] = ranks(touched)
        return out

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same by a heap over linked symbols, for words of any length."""
        merges, n = self.merges, len(symbols)
        before, after, alive = [*range(-1, n - 1)], [*range(1, n), -1], [True] * n
        heap = [(*merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges]
        heap = [(rank, i, new, symbols[i], symbols[i + 1]) for rank, new, i in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if left >= 0 and right >= 0 and (m := merges.get((symbols[left], symbols[right]))):
                    heapq.heappush(heap, (m[0], left, m[1], symbols[left], symbols[right]))
        return [s for s, live in zip(symbols, alive, strict=True) if live]


# --- the lexicon -----------------------------------------------------------------

def minimal_automaton(words: list[bytes]) -> list[np.ndarray]:
    """Arrays of the minimal acyclic automaton of sorted distinct words.

    Keys (state * 256 + byte) in ascending order, their targets, and the words passed over by taking
    them; and for each state whether a word ends there. State 0 is the start.
    """
    register: dict[tuple, int] = {}
    edges: list[dict[int, int]] = [{}]
    final = [False]
    path: list[int] = [0]  # states of the word before

    def close(depth: int) -> None:
        """Replace the states of the last word below ``depth`` by equal registered ones."""
        while len(path) > depth + 1:
            state = path.pop()
            same = register.setdefault((final[state], *edges[state].items()), state)
            if same != state:
                edges[path[-1]][last[len(path) - 1]] = same

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        for byte in word[shared:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][byte] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    close(0)

    number, order = {0: 0}, [0]
    for state in order:  # grows as states are reached
        for target in edges[state].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [t for t in edges[state].values() if t not in below]
        if todo:
            stack.extend(todo)
        else:
            below[stack.pop()] = final[state] + sum(below[t] for t in edges[state].values())
    keys, targets, passed = [], [], []
    for state in order:
        sum_before = int(final[state])
        for byte, target in edges[state].items():
            keys.append(number[state] << 8 | byte)
            targets.append(number[target])
            passed.append(sum_before)
            sum_before += below[target]
    return [np.array(keys, np.int64), np.array(targets, np.int64), np.array(passed, np.int64),
            np.array([final[s] for s in order], np.int64)]


class Lexicon:
    """The automaton and the id outputs of its words, as arrays."""

    def __init__(self, arrays: list[np.ndarray]):
        self.keys, self.targets, self.passed, self.final, self.starts, self.ids = arrays

    @classmethod
    def build(cls, words: list[str], vocabulary: Vocabulary) -> Lexicon:
        coded = sorted({w.encode("utf-8", "surrogatepass") for w in words if w})
        outputs = [vocabulary.merge(w) for w in coded]
        starts = np.cumsum([0, *map(len, outputs)])
        flat = np.array([i for o in outputs for i in o], np.int64)
        return cls([*minimal_automaton(coded), starts.astype(np.int64), flat])

    def write(self, uri: str) -> None:
        arrays = [self.keys, self.targets, self.passed, self.final, self.starts, self.ids]
        with committed(uri) as out:
            out.write(np.array([len(a) for a in arrays], np.int64).tobytes())
            for a in arrays:
                out.write(np.ascontiguousarray(a, np.int64).tobytes())

    @classmethod
    def open(cls, uri: str) -> Lexicon:
        """Memory-map the file; a store that cannot be mapped is read whole (the lexicon is bounded)."""
        from pyarrow import fs

        system, path = open_fs(uri)
        if isinstance(system, fs.LocalFileSystem):
            data = np.memmap(path, np.int64, mode="r")
        else:
            with system.open_input_file(path) as f:
                data = np.frombuffer(f.read(), np.int64)
        ends = np.cumsum(data[:6]) + 6
        return cls([data[e - n:e] for e, n in zip(ends, data[:6], strict=True)])

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the lexicon, -1 for words outside it; all words walk at once."""
        out = np.full(len(words), -1, np.int64)
        lengths = np.array([len(w) for w in words])
        if not len(words) or not len(self.keys):
            return out
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths)
        state = np.zeros(len(live), np.int64)
        total = np.zeros(len(live), np.int64)
        depth = 0
        while len(live):
            done = lengths[live] == depth
            ends = done & (self.final[state] == 1)
            out[live[ends]] = total[ends]
            live, state, total = live[~done], state[~done], total[~done]
            key = state << 8 | text[begin[live] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            live, at = live[known], at[known]
            state, total = self.targets[at], total[known] + self.passed[at]
            depth += 1
        return out

    def encoder(self, vocabulary: Vocabulary) -> Callable[[list[str]], list[bytes]]:
        """Encodes words: those of the lexicon by their outputs, the others by merging."""
        outputs = self.ids.astype("<u4")

        def run(words: list[str]) -> list[bytes]:
            coded = [w.encode("utf-8", "surrogatepass") for w in words]
            places = self.places(coded)
            unseen = np.flatnonzero(places < 0)
            out = [b""] * len(coded)
            for i in np.flatnonzero(places >= 0):
                out[i] = outputs[self.starts[places[i]]:self.starts[places[i] + 1]].tobytes()
            for i, ids in zip(unseen, vocabulary.merge_all([coded[i] for i in unseen]), strict=True):
                out[i] = ids
            return out

        return run


class Coder:
    """Encodes whole texts by a word encoder; remembers the chunks it has met."""

    def __init__(self, vocabulary: Vocabulary, encode_words: Callable[[list[str]], list[bytes]], most: int = CACHE):
        self.vocabulary, self.encode_words, self.most = vocabulary, encode_words, most
        self.known: dict[str, bytes] = {}

    def _split(self, missing: list[str]) -> tuple[list[str], list[int]]:
        """The words of chunks one after another, and where those of each chunk begin."""
        # Words cover their chunk, so one search serves all chunks and lengths tell whose a word is.
        words = self.vocabulary.words(" ".join(missing))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        wanted = np.cumsum(np.fromiter(map(len, missing), np.int64, len(missing)))
        cuts = np.searchsorted(ends, wanted) + 1
        if len(ends) and ends[-1] == wanted[-1] and (ends[cuts - 1] == wanted).all():
            return words, [0, *cuts.tolist()]
        split = [self.vocabulary.words(c) for c in missing]
        return [w for ws in split for w in ws], [0, *accumulate(map(len, split))]

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of chunks, from those of their words."""
        words, cuts = self._split(missing)
        ids = {w: self.known.get(w) for w in words}
        new = [w for w, i in ids.items() if i is None]
        ids.update(zip(new, self.encode_words(new), strict=True))
        coded = list(map(ids.__getitem__, words))
        return {c: coded[a] if b == a + 1 else b"".join(coded[a:b]) for c, a, b in zip(missing, cuts, cuts[1:], strict=False)}

    def encode_chunks(self, batch: list[list[str]]) -> list[bytes]:
        """The ids of each list of chunks, as little-endian unsigned 32-bit integers."""
        flat = list(chain.from_iterable(batch))
        found = list(map(self.known.get, flat))
        holes, at = [], -1  # places of the chunks not met before; most have been
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            holes.append(at)
        learned = self._learn(list(dict.fromkeys(map(flat.__getitem__, holes)))) if holes else {}
        for at in holes:
            found[at] = learned[flat[at]]
        if len(self.known) + len(learned) > self.most:
            # The chunks of the last texts stay: the frequent ones are among them.
            self.known.clear()
            learned = dict(zip(flat, found, strict=True))
            if len(learned) > self.most // 2:
                learned.clear()
        self.known.update((c, i) for c, i in learned.items() if len(c) <= CACHED_CHARS)
        cuts = [0, *accumulate(map(len, batch))]
        return [b"".join(found[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pattern, added = self.vocabulary.added_pattern, self.vocabulary.added
        marked = {n: pattern.findall(text) for n, text in enumerate(batch) if "<" in text}
        cut = {n: self.encode_chunks([chunks(p) for p in pattern.split(batch[n])]) for n, m in marked.items() if m}
        out = self.encode_chunks([[] if n in cut else chunks(text) for n, text in enumerate(batch)])
        for n, parts in cut.items():
            for at, name in enumerate(marked[n]):
                parts[at] += np.array([added[name]], "<u4").tobytes()
            out[n] = b"".join(parts)
        return out


class Decoder:
    """The text of ids: their tokens joined by single spaces."""

    def __init__(self, vocabulary: Vocabulary):
        top = max(vocabulary.names) + 1
        names = [vocabulary.names.get(i, "").encode() + b" " for i in range(top)]
        self.lengths = np.array([len(n) for n in names])
        self.ends = np.cumsum(self.lengths)
        self.bytes = np.frombuffer(b"".join(names), np.uint8)

    def decode(self, ids: np.ndarray, step: int = 1 << 18) -> Iterator[bytes]:
        """The decoded text in UTF-8, in parts of at most ``step`` ids."""
        for low in range(0, len(ids), step):
            part = ids[low:low + step].astype(np.int64)
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            source = np.repeat(self.ends[part] - ends, lengths) + np.arange(ends[-1])
            data = self.bytes[source]
            yield (data[:-1] if low + step >= len(ids) else data).tobytes()


# --- on Spark -------------------------------------------------------------------------

def word_counts(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """How often each word occurs in all prepared texts: word, n."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(vocabulary_path)
        found: Counter[str] = Counter()

        def pack() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for chunk, n in found.items():
                for word in vocabulary.words(chunk):
                    words[word] += n
            return emit(schema, [list(words), list(words.values())])

        for batch in batches:
            for text in texts(batch.column(0)):
                found.update(chunks(text))
            if len(found) >= HELD:
                yield pack()
                found.clear()
        yield pack()

    ship_package(documents.sparkSession)
    rows = documents.select("text").where(F.col("text").isNotNull()).mapInArrow(tidy(run), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, vocabulary_path: str, size: int = 65_536) -> str:
    """Compile the ``size`` most frequent words; returns where the lexicon file lies."""
    top = word_counts(documents, vocabulary_path).orderBy(F.desc("n"), "word").limit(size).collect()
    lexicon = Lexicon.build([r["word"] for r in top], vocabulary_of(vocabulary_path))
    uri = new_path(documents.sparkSession, "lexicon") + "/words.bin"
    lexicon.write(uri)
    return uri


_vocabularies: dict[str, Vocabulary] = {}
_coders: dict[tuple[str, str], Coder] = {}


def vocabulary_of(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def coder_of(vocabulary_path: str, lexicon_uri: str) -> Coder:
    """The worker's coder; one at a time, so that its memory is bounded."""
    key = (vocabulary_path, lexicon_uri)
    if key not in _coders:
        _coders.clear()
        vocabulary = vocabulary_of(vocabulary_path)
        _coders[key] = Coder(vocabulary, Lexicon.open(lexicon_uri).encoder(vocabulary))
    return _coders[key]


def encode(documents: DataFrame, vocabulary_path: str, lexicon_uri: str) -> DataFrame:
    """doc_id and the ids of its text, as little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary_path, lexicon_uri)
        for batch in batches:
            for part in pieces(batch, "text", STEP_BYTES):
                yield emit(schema, [part.column(0), coder.encode_batch(texts(part.column(1)))])

    ship_package(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary_of(vocabulary_path))
        for batch in batches:
            for part in pieces(batch, "ids", 4 << 20):
                out = [None if b is None else b"".join(decoder.decode(np.frombuffer(b, "<u4"))).decode("utf-8", "replace")
                       for b in part.column(1).to_pylist()]
                yield emit(schema, [part.column(0), out])

    ship_package(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string()), ("ids", pa.binary())])
DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"


def round_trip(documents: DataFrame, vocabulary_path: str, lexicon_uri: str, ids_too: bool = False) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them; with the ids if they are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(vocabulary_path, lexicon_uri)
        decoder = Decoder(coder.vocabulary)
        for batch in batches:
            for part in pieces(batch, "text", STEP_BYTES):
                coded = coder.encode_batch(texts(part.column(1)))
                decoded = []
                for ids in coded:
                    digest = hashlib.sha256()
                    for data in decoder.decode(np.frombuffer(ids, "<u4")):
                        digest.update(data)
                    decoded.append(digest.hexdigest())
                yield emit(DIGESTS, [part.column(0), [len(c) // 4 for c in coded],
                                     [hashlib.sha256(c).hexdigest() for c in coded], decoded,
                                     coded if ids_too else [None] * len(coded)])

    ship_package(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), DIGESTS_DDL)
    return rows if ids_too else rows.drop("ids")
