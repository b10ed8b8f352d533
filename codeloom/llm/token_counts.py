"""Token counts that follow edits.

A text is cut into leaves of some pre-tokens each, at places that no token can cross whatever stands
around them: between an ASCII letter and a blank before an ASCII letter. A segment tree over
the leaves has characters and tokens of every subtree. An edit finds its leaves from the
character sums, encodes only their new text, together with neighbours as long as a border is
no safe place any more, and updates the sums above.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import kernels as K
from codeloom.llm.tables import text_of

#: Characters of a leaf at least.
LEAF_CHARS = 256
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")

Edit = tuple[int, int, str]


def default_ranks() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits text."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Counter:
    """Counts tokens by the ranks of a file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> int:
        return len(self.encode(text))


def counter(path: str, pattern: str) -> Counter:
    return K.per_process(f"counter {path}", lambda: Counter(path, pattern))


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def leaves(text: str, c: Counter) -> tuple[list[str], list[int]]:
    """Leaf texts and their tokens."""
    cuts = [0] if text else []
    place = _SAFE.search(text, LEAF_CHARS)
    while place:
        cuts.append(place.start())
        place = _SAFE.search(text, place.start() + LEAF_CHARS)
    parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
    return parts, [c.whole(p) for p in parts]


class TokenTree:
    """Segment tree over the leaves of one text."""

    def __init__(self, text: str, c: Counter):
        self.counter = c
        self.texts, tokens = leaves(text, c)
        self._build(tokens)
        self.encoded = 0

    def _build(self, tokens: list[int]) -> None:
        self.size = 1
        while self.size < max(len(self.texts), 1):
            self.size *= 2
        pad = self.size - len(self.texts)
        self.texts = self.texts + [""] * pad
        self.tokens = [0] * self.size + tokens + [0] * pad
        self.chars = [0] * self.size + [len(t) for t in self.texts]
        for k in range(self.size - 1, 0, -1):
            self._pull(k)

    def _pull(self, k: int) -> None:
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.texts)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds a character, and its place within."""
        k = 1
        while k < self.size:
            k *= 2
            if place >= self.chars[k]:
                place -= self.chars[k]
                k += 1
        return k - self.size, place

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        k = leaf + self.size
        self.tokens[k], self.chars[k] = tokens, len(text)
        while k > 1:
            k //= 2
            self._pull(k)

    def _near(self, leaf: int, step: int) -> int | None:
        """Next leaf with text in a direction."""
        leaf += step
        while 0 <= leaf < self.size and not self.texts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < self.size else None

    def edit(self, start: int, length: int, new: str) -> None:
        """Replace ``length`` characters from ``start``; what reaches past the end is cut."""
        start = min(max(start, 0), self.chars[1])
        length = min(max(length, 0), self.chars[1] - start)
        if not self.chars[1]:
            self.texts, tokens = leaves(new, self.counter)
            self.encoded += len(new)
            self._build(tokens)
            return
        first, inner = self._leaf_at(min(start, self.chars[1] - 1))
        inner = inner if start < self.chars[1] else inner + 1
        last, _ = self._leaf_at(start + length - 1) if length else (first, 0)
        before = "".join(self.texts[first:last + 1])
        region = before[:inner] + new + before[inner + length:]
        left, right = self._near(first, -1), self._near(last, 1)
        while left is not None and not (
                _letter(self.texts[left][-1]) and len(region) > 1 and region[0] == " "
                and _letter(region[1])):
            region, first = self.texts[left] + region, left
            left = self._near(first, -1)
        while right is not None and not (region and _letter(region[-1])):
            region, last = region + self.texts[right], right
            right = self._near(last, 1)
        self.encoded += len(region)
        tokens = self.counter.whole(region) if region else 0
        for leaf in range(first + 1, last + 1):
            if self.texts[leaf]:
                self._set(leaf, "", 0)
        self._set(first, region, tokens)


#: What is masked, and a character without which there is none.
_MASKS = (
    ("email", "@", re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("phone", "+", re.compile(r"\+\d[\d ()-]{7,}\d")),
    ("number", "", re.compile(r"(?<![\d+])\d{9,}")),
)


def cleaning_edits(text: str) -> list[Edit]:
    """Edits (start, length, new text), from the end to the start: addresses, telephone and
    long numbers are masked; lines that equal an earlier one are deleted."""
    found: list[Edit] = []
    for name, sign, pattern in _MASKS:
        if sign in text:
            found += [(m.start(), len(m[0]), f"<{name}>") for m in pattern.finditer(text)
                      if not any(a < m.end() and m.start() < a + n for a, n, _ in found)]
    seen: set[str] = set()
    at, gone = 0, []
    for line in text.split("\n"):
        if line.strip() and line in seen:
            gone.append((max(at - 1, 0), len(line) + (at > 0), ""))
        seen.add(line)
        at += len(line) + 1
    if gone:
        found = [e for e in found
                 if not any(a < e[0] + e[1] and e[0] < a + n for a, n, _ in gone)] + gone
    return sorted(found, reverse=True)


def counted_text(text: str, edits: list[Edit], c: Counter) -> tuple[int, int, int, int]:
    """Tokens, edits, tokens after the edits, characters that were encoded again."""
    if not edits:
        n = c.whole(text)
        return n, 0, n, 0
    tree = TokenTree(text, c)
    n = tree.total
    for start, length, new in edits:
        tree.edit(start, length, new)
    return n, len(edits), tree.total, tree.encoded


def _counting(path: str, pattern: str, script: Callable[[str], list[Edit]] | None) -> Callable:
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_encoded_again"]

    def run(batches):
        c = counter(path, pattern)
        for batch in batches:
            data, offsets = K.text_array(batch.column("text"))
            for first, end, block, inner in K.blocks(data, offsets):
                raw = block.tobytes()
                out = []
                for i in range(end - first):
                    text = raw[inner[i]:inner[i + 1]].decode()
                    if script:
                        edits = script(text)
                    else:
                        edits = [(e["start"], e["length"], e["new"] or "")
                                 for e in batch.column("edits")[first + i].as_py() or ()]
                    out.append(counted_text(text, edits, c))
                cells = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, end - first),
                     *(pa.array(cells[:, k]) for k in range(4))], names)
    return run


def recounted(docs: DataFrame, script: Callable[[str], list[Edit]] | None = None,
              id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits",
              ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_edits, n_tokens_after, n_chars_encoded_again.

    Edits come from the column ``edits_col``, an array of (start, length, new), each on the
    text that the ones before it left, or from ``script``, which makes them from the text.
    Null texts count as empty, null edits as none; places past the end mean the end. An empty
    table gives no rows.
    """
    path, pattern = ranks or default_ranks()
    more = [] if script else [F.col(edits_col).alias("edits")]
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *more)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _counting(path, pattern, script),
        f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_after long,"
        " n_chars_encoded_again long")


def apply_edits(text: str, edits: list[Edit]) -> str:
    """The text after the edits, for comparison."""
    for start, length, new in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + new + text[start + max(length, 0):]
    return text
