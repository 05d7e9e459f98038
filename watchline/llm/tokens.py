"""Token ids of whole texts by public tokenizers, inside tasks. Tokenizers are only read, never trained.

Both byte-pair schemes used here work piece by piece: no token crosses certain places of a text, so equal pieces have equal
ids and each distinct piece is encoded once per worker and kept in a table of bounded size. `word_tokens` cuts at white
space (for a tokenizer that drops it); `spaced_pieces` cuts in front of a space that follows a visible character (for
tokenizers that join a space to the word after it). Tests compare both with whole texts.
"""

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import split_words

CACHE = 400_000
LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
MARK = np.array([0x21 <= b < 0x7F and not chr(b).isalnum() and chr(b) != "|" for b in range(256)])
_made = {}


def tokenizer_path(name, folder=None):
    """Place of a tokenizer file: in `folder`, or where the installed package of public tokenizers has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Ids of distinct pieces of text by one tokenizer or more, in growing arrays; each piece is encoded once until the table is full."""

    def __init__(self, *encoders, limit=CACHE):
        self.encoders, self.limit = encoders, limit
        self._clear()

    def _clear(self):
        self.place, n = {}, len(self.encoders)
        self.ids, self.starts = [np.zeros(1 << 16, np.int32) for _ in range(n)], [np.zeros(1 << 14, np.int64) for _ in range(n)]

    def of(self, pieces):
        """Place of each piece of a list: its ids by tokenizer k are ids[k][starts[k][place]:starts[k][place + 1]]."""
        if len(self.place) + len(pieces) > self.limit:
            self._clear()
        new = [p for p in pieces if p not in self.place]
        if new:
            first = len(self.place)
            self.place.update(zip(new, range(first, first + len(new))))
            for k, encode in enumerate(self.encoders):
                ids, sizes = encode(new)
                at = int(self.starts[k][first])
                self.ids[k], self.starts[k] = _room(self.ids[k], at + len(ids)), _room(self.starts[k], first + len(new) + 1)
                self.ids[k][at:at + len(ids)] = ids
                self.starts[k][first + 1:first + len(new) + 1] = at + np.cumsum(sizes)
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))


def _room(x, n):
    """The array, or a copy of twice the size if it holds fewer than n entries."""
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def _bpe(path, plain_specials):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain_specials
    return t


def word_encoder(path):
    """Pieces of a tokenizer that drops white space; strings of special tokens in a text become those tokens."""
    if path not in _made:
        _made[path] = Pieces(Words(_bpe(path, False)).encode)
    return _made[path]


class Words:
    """Encodes lists of pieces. Pieces of Latin letters alone go many at a time: each is one run of letters to the tokenizer,
    and its ids end with the one entry that closes a word."""

    def __init__(self, tokenizer, together=500):
        self.t, self.together = tokenizer, together
        entries = tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(entries.values()) + 1, bool)
        self.closes[[i for s, i in entries.items() if s.endswith("</w>")]] = True

    def encode(self, pieces):
        """(ids of all pieces in order, how many each has)."""
        letters = np.array([LETTERS(p) is not None for p in pieces], bool)
        at, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        sizes = np.zeros(len(pieces), np.int64)
        joined = [" ".join([pieces[i] for i in at[k:k + self.together]]) for k in range(0, len(at), self.together)]
        plain = [np.array(e.ids, np.int32) for e in self.t.encode_batch_fast(joined, add_special_tokens=False)]
        plain = np.concatenate(plain) if plain else np.zeros(0, np.int32)
        ends = np.flatnonzero(self.closes[plain]) + 1
        sizes[at] = np.diff(ends, prepend=0)
        others = [e.ids for e in self.t.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False)]
        sizes[rest] = [len(x) for x in others]
        ids = np.zeros(sizes.sum(), np.int32)
        starts = np.cumsum(sizes) - sizes
        ids[spread(starts[at], sizes[at])] = plain
        ids[spread(starts[rest], sizes[rest])] = [i for x in others for i in x]
        return ids, sizes


def spread(starts, counts):
    """starts[0], starts[0] + 1, ... counts[0] times, then from starts[1], and so on."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def expand(column, ends, cached):
    """Ids of rows that are runs of pieces (an Arrow column and the index after each row's last): [(ids, same index)]."""
    coded = column.dictionary_encode()
    place = cached.of(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    out = []
    for ids, bounds in zip(cached.ids, cached.starts):
        starts = bounds[place]
        sizes = bounds[place + 1] - starts
        out.append((ids[spread(starts, sizes)], np.concatenate([[0], np.cumsum(sizes)])[ends]))
    return out


def _merged(left, right):
    """Distinct values of two increasing arrays, in order."""
    both = np.sort(np.concatenate([left, right]).astype(np.int32), kind="stable")
    return both[np.diff(both, prepend=-1) != 0]


def word_pieces(texts):
    """(pieces, ends): the words of an Arrow text column, cut again in front of ASCII marks that follow a Latin letter.

    The tokenizer's pattern ends a run of letters there, and no mark of ASCII joins the letter before it. `|` is left out, so
    that strings of special tokens stay whole; where there are none, ASCII letters are lower-cased as the tokenizer does.
    """
    words, word_ends = split_words(texts)
    if not len(words):
        return words, word_ends
    if not pc.any(pc.match_substring(words, "<|")).as_py():
        words = pc.ascii_lower(words)
    words = pa.concat_arrays([words.cast(pa.string())])
    offsets = np.frombuffer(words.buffers()[1], np.int32)[:len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[:offsets[-1]]
    now, last = data[2:], data[1:-1]
    cut = LETTER[last] | ((last >= 0x80) & (last < 0xC0) & (data[:-2] == 0xC3)
                          & (last != 0x97) & (last != 0xB7))  # not the signs for times and divided by
    cut &= MARK[now]
    starts = _merged(np.flatnonzero(cut) + 2, offsets[:-1])
    bounds = np.concatenate([starts, offsets[-1:]]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), words.buffers()[2])
    return pieces, np.searchsorted(starts, np.append(offsets[:-1], offsets[-1])[word_ends])


def word_tokens(texts, path):
    """(ids, ends) of an Arrow text column by a tokenizer that drops white space; null texts have none."""
    return expand(*word_pieces(texts), word_encoder(path))[0]


def spaced_pieces(texts):
    """(pieces, ends): space + text of each row cut in front of every space that follows a visible ASCII character or a
    Latin letter with a mark, as an Arrow column, and the index after each row's last piece. Texts are not null."""
    full = pc.binary_join_element_wise(pa.scalar(" "), texts.cast(pa.string()), pa.scalar(""))
    full = pa.concat_arrays([full])  # offset 0
    offsets = np.frombuffer(full.buffers()[1], np.int32)[:len(full) + 1]
    data = np.frombuffer(full.buffers()[2], np.uint8)[:offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    last = data[1:-1]
    cut = (last > 0x20) & (last < 0x7F)
    cut |= (last >= 0x80) & (last < 0xC0) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xC9)
    cut &= data[2:] == 0x20
    starts = _merged(np.flatnonzero(cut) + 2, offsets[:-1])
    bounds = np.concatenate([starts, offsets[-1:]]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), full.buffers()[2])
    return pieces, np.searchsorted(starts, offsets[1:])


class Pair:
    """Two tokenizers over the same spaced pieces: ids of both and the bytes of every id."""

    def __init__(self, path_a, path_b):
        import sentencepiece

        self.a, self.b = _bpe(path_a, True), sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        entries = sorted((i, s) for s, i in self.a.get_vocab(with_added_tokens=False).items())
        self.bytes_a = [b""] * (entries[-1][0] + 1)
        for i, s in entries:
            self.bytes_a[i] = bytes(alphabet[c] for c in s)
        self.space, n = self.b.piece_to_id("▁"), self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        # What makes pieces independent of each other: no entry holds a space after anything else.
        assert not any("▁" in p.lstrip("▁") for p in pieces)
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.pieces = Pieces(self._a, self._b, limit=CACHE // 2)

    def _a(self, pieces):
        return _flat([_checked(e.ids, self.bytes_a, p)
                      for e, p in zip(self.a.encode_batch_fast(pieces, add_special_tokens=False), pieces)])

    def _b(self, pieces):
        # The second tokenizer puts the space in front itself, but not in front of nothing.
        ids = self.b.encode([p[1:] for p in pieces], num_threads=1)
        return _flat([_checked(x if p != " " else [self.space], self.bytes_b, p) for x, p in zip(ids, pieces)])


def _checked(ids, table, piece):
    """The ids, with -1 in front if their bytes are not those of the piece."""
    same = b"".join([table[i] for i in ids]) == piece.encode()
    return ids if same else [-1, *ids]


def _flat(lists):
    return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)


def pair_of(path_a, path_b):
    if (path_a, path_b) not in _made:
        _made[path_a, path_b] = Pair(path_a, path_b)
    return _made[path_a, path_b]


def byte_alphabet():
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
