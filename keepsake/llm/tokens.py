"""Token ids of whole texts with a public vocabulary, fast enough for large corpora.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. A byte-level
vocabulary never joins a space that stands alone between two visible characters with what
precedes it, so texts are cut there, the distinct pieces of many texts are encoded once, and
their ids are gathered by numpy. A text that holds the string of an added token is encoded
as a whole, as such a string is found before any cutting.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keepsake.llm.store import memory

#: Pieces remembered per worker (about 200 bytes each); later ones are encoded anew, which changes speed only.
REMEMBERED = 300_000
#: Bytes of a piece that is remembered at most, and characters of text that are encoded together.
PIECE_BYTES, GROUP_CHARS = 64, 6_000_000
#: Pieces that are encoded in one call.
TOGETHER = 256

_ODD_SPACE = re.compile(r" (?:(?<=\s )|\s)")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself, or the next free letter from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts in groups of bounded size; a longer text is a group of its own."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > GROUP_CHARS:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def pieces_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of the texts, cut at spaces that stand alone; the number of the
    piece at every place of all texts; and where each text begins and the last one ends."""
    odd = [bool(t) and (t[0] == " " or t[-1] == " " or _ODD_SPACE.search(t) is not None) for t in texts]
    plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string()), " ")
    other = pa.array([_LONE_SPACE.split(t) for t, o in zip(texts, odd) if o], pa.large_list(pa.large_string()))
    coded = pa.concat_arrays([plain.flatten(), other.flatten()]).dictionary_encode()
    counts = np.empty(len(texts), np.int64)
    where, odd = np.empty(len(texts), np.int64), np.array(odd, bool)
    for part, chosen in ((plain, ~odd), (other, odd)):
        counts[chosen] = pc.list_value_length(part).to_numpy(zero_copy_only=False)
    laid = np.concatenate([counts[~odd], counts[odd]])
    where[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.cumsum(laid) - laid
    bounds = np.concatenate([[0], np.cumsum(counts)])
    number = coded.indices.to_numpy().astype(np.int64)
    if odd.any():
        number = number[np.repeat(where - bounds[:-1], counts) + np.arange(bounds[-1])]
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), number, bounds


def gather(values: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` (run i has ``sizes[i]`` of them) in the order of ``numbers``, and
    where each one ends."""
    begins, taken = np.cumsum(sizes) - sizes, sizes[numbers]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(begins[numbers] - ends + taken, taken) + np.arange(total)], ends


class Remembered(dict):
    """What was made of pieces: ``make`` is called once for all new ones of a group. Those that
    occur again in their group are kept, as most others are never seen again."""

    def __init__(self, make: Callable[[list[str]], Iterable]):
        super().__init__()
        self.make = make

    def of(self, pieces: list[str], times: np.ndarray) -> list:
        found = list(map(self.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        again = (times > 1).tolist()
        for i, made in zip(new, self.make([pieces[i] for i in new])):
            found[i] = made
            if again[i] and len(self) < REMEMBERED and len(pieces[i]) <= PIECE_BYTES:
                self[pieces[i]] = made
        return found


class Encoder:
    """Encodes texts to arrays of ids; one per worker and vocabulary file."""

    def __init__(self, path: str, added_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.by_pieces = (
            isinstance(self.tokenizer.model, BPE)
            and isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
            and not self.tokenizer.pre_tokenizer.add_prefix_space
            and self.tokenizer.normalizer is None
        )
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces are remembered here; what comes is mostly new
        added = [] if added_as_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        space = byte_letters()[32]
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith(space) for i in range(self.size)])
        self.known = Remembered(self.after_space)
        memory("tokens", self.known.clear)

    def whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def after_space(self, pieces: list[str]) -> list[bytes]:
        """Ids of every piece behind a space. Many are encoded as one text and parted at the
        tokens that begin with a space, of which a piece without spaces has its first alone."""
        made: list[bytes] = []
        for at in range(0, len(pieces), TOGETHER):
            part = pieces[at : at + TOGETHER]
            joined = " " + " ".join(part)
            if joined.count(" ") != len(part):
                made += self.whole([" " + p for p in part])
                continue
            encoded = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0]
            ids = np.array(encoded.ids, self.dtype)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != len(part) or begins[0]:
                made += self.whole([" " + p for p in part])
                continue
            raw, cuts = ids.tobytes(), (begins * ids.itemsize).tolist()
            made += [raw[x:y] for x, y in zip(cuts, [*cuts[1:], len(raw)])]
        return made

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_pieces:
            raw = self.whole(texts)
            ids = np.frombuffer(b"".join(raw), self.dtype)
            return ids, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) // self.dtype.itemsize
        alone = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        if alone:
            texts = list(texts)
        raw_alone = self.whole([texts[i] for i in alone])
        for i in alone:
            texts[i] = ""
        pieces, numbers, bounds = pieces_of(texts)
        heads = numbers[bounds[:-1]]
        numbers[bounds[:-1]] = len(pieces) + np.arange(len(texts))
        raw_heads = self.whole([pieces[h] for h in heads.tolist()])
        for i, raw in zip(alone, raw_alone):
            raw_heads[i] = raw
        times = np.bincount(numbers, minlength=len(pieces) + len(texts))[: len(pieces)]
        used = np.flatnonzero(times)
        raw, later = [b""] * len(pieces) + raw_heads, used.tolist()
        for i, found in zip(later, self.known.of([pieces[i] for i in later], times[used])):
            raw[i] = found
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        ids, ends = gather(np.frombuffer(b"".join(raw), self.dtype), sizes, numbers)
        return ids, ends[bounds[1:] - 1]

    def encode(self, texts: Iterable[str | None], end_id: int | None = None) -> list[np.ndarray]:
        """One array of ids per text, closed by ``end_id`` if given."""
        out = []
        for group in grouped(t or "" for t in texts):
            ids, ends = self._group(group)
            if end_id is not None:
                ids = np.insert(ids, ends, np.array(end_id, self.dtype))
                ends = ends + np.arange(1, len(ends) + 1)
            out += np.split(ids, ends[:-1])
        return out


@lru_cache(maxsize=4)
def encoder(path: str, added_as_text: bool = False) -> Encoder:
    return Encoder(path, added_as_text)
