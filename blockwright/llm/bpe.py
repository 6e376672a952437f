"""Byte-level BPE encoding and decoding, by a depth-first walk of a trie of distinct words.

The token that ends the encoding of a prefix is decided by shorter prefixes alone: it is the one token t that ends the
prefix such that the token which ends the rest and t stay two tokens when encoded together. So a word needs one state,
the length of its last token, for every prefix, and words that share a prefix share its states. Distinct words are laid
out in sorted order, which is the depth-first order of their trie; the walk keeps the states of the current path only
and computes the state of every trie node once. A word's encoding is read off its path from the end.

The tokens that may end a prefix come from an Aho-Corasick automaton of the vocabulary, whose state is carried along the
path. What a worker remembers is bounded: PAIRS token pairs of either kind, some 40 MB, and the encodings of the batch
before, which go at the end of the task.

Defined cases: null and empty texts have no ids and decode to an empty text; special tokens named in the file are ids of
their own wherever their string occurs, as the public library has it by default; other columns pass through and the
operator's own columns replace clashing ones; long texts are worked off word by word.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockwright.llm._store import fields, plain_names, small_batches, table
from blockwright.llm._words import released

#: Pairs of tokens of either kind, tokens' edges, and steps of the automaton that are remembered.
PAIRS, CACHE_EDGES, STEPS = 250_000, 20_000, 300_000
#: Characters of text that are encoded together; what is remembered of words is as large at most.
BATCH = 1 << 21
#: Stands for the token before a word's first.
NONE = (1 << 20) - 1
#: The published splitting pattern of this family of vocabularies; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone.
ASCII_PATTERN = PATTERN.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
#: Outside these ranges the pattern library and the tokenizer may know different versions of Unicode; such texts are
#: split by the tokenizer's own splitter.
_UNSURE = re.compile("[^\x00-՗؀-߿ऀ-௿ഀ-ൿḀ-₎₠-⯿　-ꒌ가-﫿︀-￿\U0001f300-\U0001faff\U00020000-\U0002b700]")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such files: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A tokenizer file, and the encodings of the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or model.get("dropout"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.path = path
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self._made = {a + b: ((a, b), r) for (a, b), r in self.rank.items()}
        self._edge: dict[bytes, tuple] = {}
        if max(self.ids.values()) >= NONE:
            raise ValueError(f"{path}: too many tokens")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self._packed = {i: i.to_bytes(4, "little") for i in self.ids.values()}
        self._split, self._split_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN, re.ASCII).findall
        self._library = None
        self._good: set[int] = set()
        self._bad: set[int] = set()
        self._sizes = {i: len(t) for t, i in self.ids.items()}
        self.before: dict[str, bytes] = {}
        self._automaton()

    def _automaton(self) -> None:
        """The tokens as an Aho-Corasick automaton: ``_goto`` by state * 256 + byte, ``_fail`` by state, and ``_ends``, the
        (length, id) of every token that ends where the state stands, longest first."""
        goto, fail, ends = {}, [0], [()]
        own: dict[int, tuple[int, int]] = {}
        for t, i in self.ids.items():
            s = 0
            for c in t:
                n = goto.get(s << 8 | c)
                if n is None:
                    n = goto[s << 8 | c] = len(fail)
                    fail.append(0)
                    ends.append(())
                s = n
            own[s] = (len(t), i)
        below: dict[int, list[tuple[int, int]]] = {}
        for k, n in goto.items():
            below.setdefault(k >> 8, []).append((k & 255, n))
        level = [0]
        while level:
            deeper = []
            for s in level:
                for c, n in below.get(s, ()):
                    f = fail[s]
                    if s:
                        while (to := goto.get(f << 8 | c)) is None and f:
                            f = fail[f]
                        fail[n] = to or 0
                    ends[n] = ((own[n],) if n in own else ()) + ends[fail[n]]
                    deeper.append(n)
            level = deeper
        self._goto, self._fail, self._ends = goto, fail, ends

    def merged(self, parts: list[bytes]) -> list[bytes]:
        """Plain BPE: the merge of lowest rank first, leftmost first."""
        while len(parts) > 1:
            best = min(((self.rank.get((parts[k], parts[k + 1]), 1 << 60), k) for k in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _edges(self, t: bytes) -> tuple[list, list]:
        """The pieces that stand at the right and at the left edge of t while it is merged, each with the rank of the
        merge that ends it. None if t is not what its own bytes merge to."""
        found = self._edge.get(t)
        if found is None:
            if self.merged([t[k : k + 1] for k in range(len(t))]) != [t]:
                found = ((), ())
            else:
                found = tuple([] for _ in range(2))
                for side, out in enumerate(found):
                    piece, ends = t, 1 << 60
                    while True:
                        out.append((piece, ends))
                        if len(piece) == 1:
                            break
                        halves, ends = self._made[piece]
                        piece = halves[1 - side]
            if len(self._edge) > CACHE_EDGES:
                self._edge.clear()
            self._edge[t] = found
        return found

    def _two(self, pair: int) -> bool:
        """Whether the two tokens stay two side by side; with NONE for the first, whether the second is one token.

        They do unless some merge joins a piece at the right edge of the first with one at the left edge of the second
        before either is merged otherwise. At equal rank the merge further left comes first.
        """
        a, b = pair >> 20, pair & NONE
        left = self._edges(self.token[b])[1]
        right = self._edges(self.token[a])[0] if a != NONE else [(b"", 0)]
        rank = self.rank
        found = bool(left) and bool(right) and not any((r := rank.get((x, y))) is not None and r < x_ends and r <= y_ends for x, x_ends in right for y, y_ends in left)
        known = self._good if found else self._bad
        if len(known) > PAIRS:
            known.clear()
        known.add(pair)
        return found

    def _step(self, at: int) -> int:
        """The automaton's next state where no token goes on; remembered, but not without bound."""
        goto, s, c = self._goto, at >> 8, at & 255
        while (to := goto.get(s << 8 | c)) is None and s:
            s = self._fail[s]
        if len(goto) < STEPS:
            goto[at] = to or 0
        return to or 0

    def walk(self, words: list[bytes]):
        """(word, its tokens' packed ids) of distinct words in sorted order."""
        goto, fail, ends, good, bad, two, packed, sizes = self._goto, self._fail, self._ends, self._good, self._bad, self._two, self._packed, self._sizes
        state, last = [0], [NONE]  # of every prefix on the current path: its state, its last token
        before = b""
        for word in words:
            n = len(word)
            if word.startswith(before):
                shared = len(before)
            else:
                shared = 0
                for x, y in zip(before, word):  # noqa: B905  up to where they differ
                    if x != y:
                        break
                    shared += 1
                del state[shared + 1 :], last[shared + 1 :]
            s, end = state[shared], shared
            for c in word[shared:]:
                at = s << 8 | c
                if (s := goto.get(at)) is None:
                    s = self._step(at)
                end += 1
                for k, t in ends[s]:
                    pair = last[end - k] << 20 | t
                    if pair in good:
                        break
                    if pair not in bad and two(pair):
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                state.append(s)
                last.append(t)
            t = last[n]
            if sizes[t] == n:
                yield word, packed[t]
            else:
                out, end = [packed[t]], n - sizes[t]
                while end:
                    t = last[end]
                    out.append(packed[t])
                    end -= sizes[t]
                out.reverse()
                yield word, b"".join(out)
            before = word

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self._split_ascii(text)
        if not _UNSURE.search(text):
            return self._split(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens."""
        if not self._special or not any(s in text for s in self.special):
            return self.split(text)
        out: list[str | int] = []
        for part in self._special.split(text):
            out.extend([self.special[part]] if part in self.special else self.split(part) if part else [])
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids (little-endian, 32 bits each) of each text."""
        number: defaultdict[str | int, int] = defaultdict()  # of a distinct word, so that texts hold no words of their own
        number.default_factory = number.__len__
        places = [array("I", map(number.__getitem__, self.pieces(t))) for t in texts]
        number.default_factory = None  # else the two hold each other, and their words with them
        codes, old, new = [b""] * len(number), self.before, {}
        for w, k in number.items():
            if isinstance(w, int):
                codes[k] = w.to_bytes(4, "little")
            elif (ids := old.get(w)) is not None:
                codes[k] = ids
            else:
                new[w.encode()] = k
        for word, ids in self.walk(sorted(new)):
            codes[new[word]] = ids
        self.before = dict(zip(number, codes, strict=True))
        return [b"".join(map(codes.__getitem__, p)) for p in places]

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


@lru_cache(2)
def _loaded(path: str) -> ByteBPE:
    """Kept by each Python worker from task to task."""
    return ByteBPE(path)


def _coded(path: str, text: bool):
    def run(batches):
        bpe = _loaded(path)
        for b in batches:
            texts = b.column("text").fill_null("")
            at = 0
            while at < b.num_rows:
                part, size = [], 0
                while at + len(part) < b.num_rows and size < BATCH:
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1])
                ids = bpe.encode_batch(part)
                rest = b.slice(at, len(part))
                keep = [c for c in b.schema.names if text or c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(rest.column(c) for c in keep), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())],
                    names=[*keep, "n_tokens", "ids", "decoded"],
                )
                at += len(part)
        bpe.before = {}

    return released(run)


def encoded(docs: DataFrame, path: str, text: bool = True) -> DataFrame:
    """``docs`` (without its text, if not ``text``) with n_tokens, ids (packed, little-endian unsigned 32-bit) and decoded, the text that the ids give.

    A map over rows; ``path`` names a tokenizer file that every executor can read.
    """
    docs, named = plain_names(small_batches(docs).drop("n_tokens", "ids", "decoded"))
    kept = docs if text else docs.drop("text")
    return named(docs.mapInArrow(_coded(path, text), f"{fields(kept)}{', ' if kept.columns else ''}n_tokens long, ids binary, decoded string"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark, sf_dir):
    out = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path(), text=False)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
