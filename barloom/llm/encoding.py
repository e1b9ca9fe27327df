"""Token ids of whole texts by a public tokenizer, with a bounded memory of the chunks seen."""

from __future__ import annotations

import os
import re
import string
from codecs import charmap_decode
from collections.abc import Callable, Iterable
from functools import cache
from operator import attrgetter

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Characters with Unicode's White_Space property.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Chunks that no token crosses. Byte-level: a run of other characters with the space before it, and white space runs
#: as that tokenizer's own pattern cuts them. Word-level: runs of other characters; white space makes no token.
CHUNKS = {
    "byte_bpe_50k.json": rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+",
    "word_bpe_49k.json": rf"[^{WHITE}]+",
}
#: White space to Python's split(), but not to the tokenizers.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: No character before the first combining mark changes when a text is composed, and Python lowers them as the library does;
#: but this one becomes a letter and a mark, which would join the marks behind it.
COMBINING, DOTTED = "\u0300", "\u0130"
MEMORY = 1_000_000
ID = attrgetter("id")


def _byte_letters() -> str:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies: itself where it is one, else the
    next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return "".join([letter[b] for b in range(256)])


_LETTERS = _byte_letters()


class _Seen(dict):
    """Chunks seen, with their ids; a new one is looked up when it is first asked for."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = ids = self.learn(chunk)
        return ids


class Encoder:
    """`ids(texts)` gives each text's ids as little-endian unsigned 32-bit bytes, equal to encoding it in one go."""

    def __init__(self, name: str) -> None:
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.pattern = re.compile(CHUNKS[name])
        self.bare = not self.pattern.match(" ")  # white space makes no token
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.seen = _Seen(self._chunk)
        self.after = _Seen(lambda chunk: self._chunk(" " + chunk))  # chunks with a space before them
        self.gap = re.compile(f" [{WHITE}]")

    def _whole(self, text: str) -> bytes:
        return b"".join([self.packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _letters(self, chunk: str) -> bytes | None:
        """Ids of one run of letters (a space may stand before it), which the library's model takes as it is."""
        if self.normalizer is not None:
            if chunk.isascii():
                chunk = chunk.lower()
            else:
                chunk = chunk.lower() if max(chunk) < COMBINING else self.normalizer.normalize_str(chunk)
                if not chunk.isalpha():
                    return None
        letters, _ = charmap_decode(chunk.encode(), "strict", _LETTERS)
        return b"".join(map(self.packed.__getitem__, map(ID, self.model.tokenize(letters))))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one chunk. ASCII marks behind a run of letters are a run of their own to either tokenizer."""
        if chunk.lstrip(" ").isalpha():
            ids = self._letters(chunk)
            if ids:
                return ids
        body = chunk.rstrip(string.punctuation)
        if body != chunk and body.lstrip(" ").isalpha():
            plain = self.normalizer is None or body.isascii() or (max(body) < COMBINING and DOTTED not in body)
            ids = self._known(body) if plain else self._letters(body)
            if ids:
                return ids + self.seen[chunk[len(body) :]]
        parts = self.pattern.findall(chunk)
        return b"".join(map(self._known, parts)) if len(parts) > 1 else self._whole(chunk)

    def _known(self, chunk: str) -> bytes:
        return self.after[chunk[1:]] if chunk[0] == " " else self.seen[chunk]

    def _text(self, text: str) -> bytes:
        if any(map(text.__contains__, self.special)):
            return self._whole(text)
        if self.bare:
            parts = text.split() if not any(map(text.__contains__, SEPARATORS)) else self.pattern.findall(text)
            return b"".join(map(self.seen.__getitem__, parts))
        if self.gap.search(text):
            return b"".join(map(self._known, self.pattern.findall(text)))
        first, *rest = text.split(" ")  # each space starts a chunk, as no white space follows one
        return self._known(first) + b"".join(map(self.after.__getitem__, rest)) if first else b"".join(map(self.after.__getitem__, rest))

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        if len(self.seen) + len(self.after) > MEMORY:
            self.seen.clear()
            self.after.clear()
        return [self._text(t or "") for t in texts]


@cache
def encoder(name: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(name)
