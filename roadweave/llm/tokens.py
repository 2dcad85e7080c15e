"""Token ids of whole texts by a public tokenizer file, with every word encoded once.

Both vocabularies used here cut a text into pieces before they merge, and never across a space that a non-space follows. So a
text may be cut there, each chunk be encoded by itself and the ids be joined; the result is the tokenizer's own. Chunks
repeat, so their ids are kept in a cache of bounded size. Chunks over plain Latin letters, digits, punctuation and
line ends are cut by the file's rule restated over that alphabet and merged by the tokenizer's model; all others go
through the whole tokenizer.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np

from roadweave.llm.common import threads_off

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
ALPHABET = f"{LETTERS}0-9!-/:-@\\[-`{{-~\n"
PLAIN, OTHER = re.compile(f"[{ALPHABET}]*"), re.compile(f"[^{ALPHABET}\x00]")
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED = re.compile(f"{SHORT}| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+")
WORDS = re.compile(f"{SHORT}|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+|\\x20")
LOOSE = re.compile(r" (?=\s|\Z)")
CUT = re.compile(r" (?=\S)")


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after another."""
    ends = sizes.cumsum()
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def plain_ones(keys: list[str]) -> np.ndarray:
    """Which keys are over the plain alphabet alone; all are looked through at once."""
    joined = "\x00".join(keys)
    if joined.count("\x00") >= len(keys):
        return np.fromiter((PLAIN.fullmatch(k) is not None for k in keys), bool, len(keys))
    ends = (np.fromiter(map(len, keys), np.int64, len(keys)) + 1).cumsum()
    out = np.ones(len(keys), bool)
    out[np.searchsorted(ends, np.fromiter((m.start() for m in OTHER.finditer(joined)), np.int64), "right")] = False
    return out


class Encoder:
    """``encode(texts)`` gives all ids in one array and the number of ids of each text.

    Null texts count as empty. Special tokens' strings in a text are ordinary text. Memory is bounded by ``most``
    cached chunks (beyond them those seen once are forgotten) and by blocks of ``block`` code points, however long a
    text is.
    """

    def __init__(self, source: str, most: int = 400_000, block: int = 1_000_000):
        threads_off()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True
        self.spaced = json.loads(source)["pre_tokenizer"]["type"] == "ByteLevel"
        self.model, self.most, self.block = self.tokenizer.model, most, block
        self.letters = byte_letters()
        self.numbers = [*range(self.tokenizer.get_vocab_size())]  # an id's number is one object, however many pieces hold it
        self.known: dict[str, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.ids, self.sizes, self.hits = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def shrink(self) -> None:
        """Forget the chunks seen once; if that is too few, all but the more frequent half."""
        keep = self.hits > 1
        if keep.sum() > self.most // 2:
            keep = self.hits > np.median(self.hits)
        starts = self.sizes.cumsum() - self.sizes
        self.ids, self.sizes = self.ids[ragged(starts[keep], self.sizes[keep])], self.sizes[keep]
        self.known = {k: i for i, k in enumerate(itertools.compress(self.known, keep))}
        self.hits = self.hits[keep] // 2

    def learn(self, missing: list[str]) -> None:
        is_plain = plain_ones(missing).tolist()
        plain = [*itertools.compress(missing, is_plain)]
        rest = [k for k, ok in zip(missing, is_plain, strict=True) if not ok] if len(plain) < len(missing) else []
        ids: list[int] = []
        sizes = []
        if plain:
            cut = SPACED.findall(" " + " ".join(plain)) if self.spaced else WORDS.findall(" " + " ".join(plain).lower())
            if len(self.pieces) > self.most:
                self.pieces = {}
            known, model, letters, numbers = self.pieces, self.model, self.letters, self.numbers
            space, line = letters[32], letters[10]
            size = -1
            for piece in cut:
                if piece[0] == " ":
                    if size >= 0:
                        sizes.append(size)
                    size = 0
                    if piece == " " and not self.spaced:
                        continue
                if (found := known.get(piece)) is None:
                    shown = piece.replace(" ", space).replace("\n", line) if piece.isascii() else piece.encode().decode("latin-1").translate(letters)
                    found = known[piece] = tuple([numbers[t.id] for t in model.tokenize(shown)])
                ids += found
                size += len(found)
            sizes.append(size)
        for key in rest:
            found = self.tokenizer.encode((key[1:] if key[:1] == " " else " " + key) if self.spaced else key, add_special_tokens=False).ids
            ids += found
            sizes.append(len(found))
        self.known.update(zip(plain + rest, range(len(self.sizes), len(self.sizes) + len(sizes)), strict=True))
        self.ids = np.concatenate((self.ids, np.array(ids, np.uint32)))
        self.sizes = np.concatenate((self.sizes, np.array(sizes, np.int64)))

    def chunks(self, text: str) -> Iterator[list[str]]:
        """Blocks of cache keys. In a spaced vocabulary a key starts with a space if its chunk has none before it."""
        if self.spaced and LOOSE.search(text):
            parts = CUT.split(text)
        elif len(text) <= self.block:
            parts = text.split(" ")
        else:
            start = 0
            while start < len(text):
                cut = CUT.search(text, start + self.block) if start + self.block < len(text) else None
                end = cut.start() if cut else len(text)
                part = text[start:end].split(" ")
                if self.spaced and start == 0:
                    part[0] = " " + part[0]
                yield part
                start = end + 1
            return
        if self.spaced:
            parts[0] = " " + parts[0]
        yield parts

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        out, counts, keys, owners = [], np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            for part in self.chunks(text):
                keys += part
                owners.append((i, len(part)))
                if len(keys) >= 250_000:
                    out.append(self.flush(keys, owners, counts))
                    keys, owners = [], []
        out.append(self.flush(keys, owners, counts))
        return np.concatenate(out), counts

    def flush(self, keys: list[str], owners: list[tuple[int, int]], counts: np.ndarray) -> np.ndarray:
        if not keys:
            return np.zeros(0, np.uint32)
        if len(self.known) > self.most:
            self.shrink()
        at = np.fromiter(map(self.known.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        if len(new := np.flatnonzero(at < 0)):
            missing = [keys[i] for i in new]
            self.learn(list(dict.fromkeys(missing)))
            at[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(new))
        seen = np.bincount(at, minlength=len(self.sizes))
        seen[: len(self.hits)] += self.hits
        self.hits = seen
        size = self.sizes[at]
        done = np.concatenate(([0], size.cumsum()[np.cumsum([n for _, n in owners]) - 1]))
        np.add.at(counts, [i for i, _ in owners], np.diff(done))
        return self.ids[ragged((self.sizes.cumsum() - self.sizes)[at], size)]


def by_text(texts: Sequence[str | None], most: int = 500_000) -> Iterator[slice]:
    """Slices of a batch of about ``most`` code points each, so what a step holds is bounded."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
