"""Token ids by a published tokenizer file, inside tasks."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

SLICE = 1 << 22                # characters of texts encoded together
TOGETHER = 100                 # new words encoded as one text: more of them cost more each
CACHE = 400_000                # remembered words of a worker, in two generations
# Characters for which lower-casing, normalisation and the word split below are those of
# the tokenizer file: no control separators, nothing beyond Latin-1.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\xff]*")
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
# Words: 's 't 're 've 'm 'll 'd, runs of letters, single numbers, runs of anything else but spaces.
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_KIND = np.asarray([_SPACE if re.match(r"\s", c) else _LETTER if re.match(f"[{_LETTERS}]", c) else _NUMBER if re.match(f"[{_NUMBERS}]", c) else _OTHER
                    for c in map(chr, range(256))], np.uint8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_words(text: str) -> tuple[pa.Array, np.ndarray]:
    """Words of a lower-cased Latin-1 text that begins with a space and ends with two,
    and where each starts."""
    raw = np.frombuffer(text.encode("latin-1"), np.uint8)
    kind = _KIND[raw]
    first = kind == _NUMBER
    first[1:] |= kind[1:] != kind[:-1]
    marks = np.flatnonzero(raw == ord("'"))
    marks = marks[kind[marks - 1] != _OTHER]
    one, two = raw[marks + 1], raw[marks + 2]
    short = marks[np.isin(one, list(b"stmd"))]
    long = marks[np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
    for at, length in ((short, 2), (long, 3)):
        first[at + 1], first[at + length] = False, True
    inside = kind != _SPACE
    first &= inside
    offsets = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return words, np.flatnonzero(first)


class Encoder:
    """ids of texts as little-endian unsigned 32-bit integers, equal to those of
    ``encode(text, add_special_tokens=False)``.

    Where a BPE file marks word ends, words are encoded once and remembered (up to
    ``CACHE``); texts of up to ``SLICE`` characters in all are split together and each of
    their words is looked up once. Any text with characters outside ``_PLAIN`` or a possible
    special token goes to the library as it is."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            vocabulary = self.library.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            # the same model, for words lower-cased and split already
            self.splitter = Tokenizer(self.library.model)
            self.splitter.pre_tokenizer = pre_tokenizers.Sequence([
                pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held: list[int] = []
        size = 0
        for k, t in enumerate(texts):
            if self.ends is None or "<|" in t or not _PLAIN.fullmatch(t):
                out[k] = self.whole(t)
                continue
            if held and size + len(t) > SLICE:
                self.together(texts, held, out)
                held, size = [], 0
            held.append(k)
            size += len(t)
        if held:
            self.together(texts, held, out)
        return out

    def together(self, texts: list[str], held: list[int], out: list[bytes]) -> None:
        """Fills in the ids of the texts at the places held."""
        words, places = split_words(" " + " ".join([texts[k] for k in held]).lower() + "  ")
        words = words.dictionary_encode()
        coded = self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begins = np.cumsum(sizes) - sizes
        which = words.indices.to_numpy()
        stops = np.append(0, np.cumsum(sizes[which]))
        ids = np.repeat(begins[which] - stops[:-1], sizes[which])
        ids += np.arange(len(ids))
        raw = np.frombuffer(b"".join(coded), "<u4")[ids].tobytes()
        ends = np.cumsum([len(texts[k]) + 1 for k in held])
        at = 0
        for k, stop in zip(held, stops[np.searchsorted(places, ends)].tolist()):
            out[k], at = raw[4 * at:4 * stop], stop

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        if len(self.words) > CACHE // 2:             # words not seen again go with the older generation
            self.words, self.older = {}, self.words
        fresh = [w for w in words if w not in self.words]
        self.words.update((w, self.older[w]) for w in fresh if w in self.older)
        self.learn(sorted(w for w in fresh if w not in self.older))
        return list(map(self.words.__getitem__, words))

    def learn(self, new: list[bytes]) -> None:
        """Many words are encoded as one text and told apart by the marks of word ends."""
        for k in range(0, len(new), TOGETHER):
            part = new[k:k + TOGETHER]
            (coded,) = self.splitter.encode_batch_fast([b" ".join(part).decode("latin-1")], add_special_tokens=False)
            ids = np.asarray(coded.ids, "<u4")
            stops = (np.nonzero(self.ends[ids])[0] + 1).tolist()
            raw = ids.tobytes()
            if len(stops) == len(part):
                self.words.update(zip(part, [raw[4 * a:4 * b] for a, b in zip([0] + stops, stops)]))
            else:
                self.words.update((w, self.whole(w.decode("latin-1"))) for w in part)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
