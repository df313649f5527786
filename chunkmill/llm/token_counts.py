"""Token counts by a finite-state transducer compiled from a byte-level tokenizer file.

The tokenizer (its splitting pattern and its merges) becomes one deterministic transducer over
characters. A state holds where the pattern stands (in a run of letters, of white space, after
an apostrophe ...) and the *frontier* of the piece being read: every suffix of it that some
token may still grow from, with the last token of the prefix before that suffix and the number
of tokens of that prefix against the number now. That is all the future depends on. Each
transition is annotated with how the number of tokens changes. States are compiled when first
met and shared by all later texts; a table that has grown beyond ``_MOST`` transitions starts
anew, so memory is bounded.

Long texts are cut into chunks anywhere; special strings are taken out first, as each side of one
is a text of its own. What a chunk does to any entry state is its *state map*: the characters up
to the first place where the state no longer depends on how the chunk was entered (the head, a
word or less), and from there on the tokens counted and the exit state. Maps compose
associatively: the exit state of one chunk runs through the head of the next. So chunks are run in
parallel as rows, and a prefix scan over a text's maps gives its count. A text's first chunk is
entered at the beginning, and has no head.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import codec

#: Compiled transitions kept.
_MOST = 800_000
#: Characters of a chunk.
CHUNK = 1 << 16

_SPACES = frozenset([*map(chr, range(9, 14)), " ", "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"])
#: Where a chunk's state may no longer depend on how it was entered: another kind of character than the one before.
_TURN = regex.compile(r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}|(?<=[^\s\p{L}\p{N}])[\s\p{L}\p{N}]")


def _kind(c: str) -> str:
    """Class of a character for the pattern: letter, number, white space, or other."""
    if c in _SPACES:
        return "W"
    general = unicodedata.category(c)[0]
    return general if general in "LN" else "O"


class _State(dict):
    """Transitions by character: (next state, change in tokens). ``rest``: change at the end of the text."""

    __slots__ = ("key", "machine", "rest")

    def __missing__(self, c: str):
        made = self[c] = self.machine.step(self.key, c)
        self.machine.compiled += 1
        return made


class CountTransducer:
    """Deterministic transducer of one byte-level tokenizer file (no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level tokenizer without normaliser is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.coder = codec(path)
        self.specials = self.coder.specials
        # trie over the tokens' bytes: node -> {byte: node}; token that ends at a node
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for _, (token, _) in self.coder.suffixes.items():
            at = 0
            for b in self.coder_bytes(token):
                nxt = self.children[at].get(b)
                if nxt is None:
                    nxt = self.children[at][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                at = nxt
            self.token[at] = token
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    @functools.lru_cache(maxsize=None)  # noqa: B019 - one machine lives as long as the worker
    def coder_bytes(self, token: int) -> bytes:
        left = self.coder.left.get(token)
        if left is None:
            text = self.coder.token_text[token]
            return bytes([_alphabet()[text]])
        return self.coder_bytes(left) + self.coder_bytes(self.coder.right[token])

    def reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.compiled = 0
        self.begin = self.state(("E",))

    def state(self, key: tuple) -> _State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = _State()
            found.machine, found.key, found.rest = self, key, 0
            if key[0] == "W":  # a run of white space up to the end of the text is one piece
                found.rest = self.extend(key[1], key[2])[1]
        return found

    #: Frontier of a piece of which nothing has been read: (trie node, last token before, tokens before - tokens now).
    EMPTY = ((0, -1, 0),)

    def extend(self, frontier: tuple, c: str) -> tuple[tuple, int]:
        """The frontier after another character of the piece, and the change in tokens."""
        change = 0
        for b in c.encode():
            grown, token, tokens = [], -1, 0
            for node, before, count in frontier:
                node = self.children[node].get(b)
                if node is None:
                    continue
                grown.append((node, before, count))
                t = self.token[node]
                if t >= 0 and (before < 0 or self._fit(before, t)):
                    token, tokens = t, count + 1
            frontier = (*((n, t, k - tokens) for n, t, k in grown if self.children[n]), (0, token, 0))
            change += tokens
        return frontier, change

    def _fit(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            found = self.fits[a, b] = self.coder._first_crossing(a, b) == 1 << 60
        return found

    def piece(self, text: str, kind: str) -> tuple[tuple, int]:
        frontier, change = self.EMPTY, 0
        for c in text:
            frontier, d = self.extend(frontier, c)
            change += d
        return (kind, frontier), change

    def step(self, key: tuple, c: str) -> tuple[_State, int]:
        """Compile one transition. Keys: ("E",) between pieces; (L|N|O, frontier) in a run;
        ("Q", frontier) in a piece that is one apostrophe so far; ("R", frontier, x) after an
        apostrophe and x, which may still become a contraction; ("W", frontier, last) in white
        space, of which ``last`` is not yet counted."""
        here, what = key[0], _kind(c)
        if here == "R" and c == {"r": "e", "v": "e", "l": "l"}[key[2]]:
            apart = self.piece("'", "O")[1] + self.piece(key[2], "L")[1]
            return self.state(("E",)), self.piece(f"'{key[2]}{c}", "O")[1] - apart
        if here == "R":
            here, key = "L", ("L", key[1])
        if here == "Q":
            if c in "stmd":
                return self.state(("E",)), self.piece("'" + c, "O")[1] - self.piece("'", "O")[1]
            if c in "rvl":
                (_, frontier), change = self.piece(c, "L")
                return self.state(("R", frontier, c)), change
            here, key = "O", ("O", key[1])
        if here == what == "W":
            frontier, change = self.extend(key[1], key[2])
            return self.state(("W", frontier, c)), change
        if here == what:
            frontier, change = self.extend(key[1], c)
            return self.state((here, frontier)), change
        if what == "W":
            return self.state(("W", self.EMPTY, c)), 0
        if here == "W" and key[2] == " ":
            made, change = self.piece(" " + c, what)
            return self.state(made), change
        pending = self.piece(key[2], "W")[1] if here == "W" else 0
        made, change = self.piece(c, what)
        return self.state(("Q", made[1]) if c == "'" else made), pending + change

    def run(self, state: _State, text: str) -> tuple[_State, int]:
        if self.compiled > _MOST:
            key = state.key
            self.reset()
            state = self.state(key)
        n = 0
        for c in text:
            state, d = state[c]
            n += d
        return state, n

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings count as one."""
        parts = self.specials.split(text) if self.specials and "<" in text else [text]
        n = len(parts) - 1
        for part in parts:
            state, d = self.run(self.begin, part)
            n += d + state.rest
        return n

    def settled(self, c: str) -> tuple[_State, int]:
        """State and change in tokens at a character that begins a piece, whatever stood before."""
        what = _kind(c)
        if what == "W":
            return self.state(("W", self.EMPTY, c)), 0
        made, change = self.piece(c, what)
        return self.state(("Q", made[1]) if c == "'" else made), change


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


@functools.lru_cache(maxsize=1)
def _alphabet() -> dict[str, int]:
    from .vocab import byte_alphabet

    return {c: b for b, c in enumerate(byte_alphabet())}


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def _turn(text: str) -> int:
    """The first place at which a piece begins for sure, -1 if there is none: the kind changes there, and
    what stands before is neither white space nor an apostrophe (of a contraction)."""
    for m in _TURN.finditer(text):
        before = text[m.start() - 1]
        if before != "'" and "W" != _kind(before) != _kind(m[0]):
            return m.start()
    return -1


def chunk_map(machine: CountTransducer, text: str, first: bool = False) -> tuple[str, int | None, tuple | None]:
    """State map of one chunk: its head, then the tokens from the first settled place to the end and
    the key of the exit state (None, None: there is no such place, and the head is the chunk)."""
    if first:
        state, n = machine.run(machine.begin, text)
        return "", n, state.key
    at = _turn(text)
    if at < 0:
        return text, None, None
    state, n = machine.settled(text[at])
    state, d = machine.run(state, text[at + 1 :])
    return text[:at], n + d, state.key


def compose(machine: CountTransducer, a: tuple, b: tuple) -> tuple:
    """The map of two chunks that follow each other (associative)."""
    if a[1] is None:
        return a[0] + b[0], b[1], b[2]
    state, n = machine.run(machine.state(a[2]), b[0])
    if b[1] is None:
        return a[0], a[1] + n, state.key
    return a[0], a[1] + n + b[1], b[2]


def apply_map(machine: CountTransducer, whole: tuple) -> int:
    """Tokens of a text from its map, entered at its beginning."""
    state, n = machine.run(machine.begin, whole[0])
    if whole[1] is None:
        return n + state.rest
    return n + whole[1] + machine.state(whole[2]).rest


def _packed(key: tuple | None) -> str | None:
    return None if key is None else json.dumps(key)


def _unpacked(key: str | None) -> tuple | None:
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    return None if key is None else tuples(json.loads(key))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Tokens of every whole text.

    Returns ``id_col``, ``n_bytes`` long (UTF-8), ``n_tokens`` long, ``over_limit`` boolean
    (``n_tokens > limit``): one row for each input row (repeated rows and null ids stay), no
    other input column. Null text counts as empty (0 bytes, 0 tokens). The state maps of a text's
    chunks meet in one row: a few dozen bytes for each ``chunk`` characters. ``tokenizer`` is the path
    of a tokenizer file, here and on every worker.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "n_bytes", "part", "i", "head", "count", "exit"]

    def maps(batches):
        machine = transducer(tokenizer)
        for batch in batches:
            cols, out = batch.to_pydict(), []
            for text, i in zip(cols["text"], cols["i"], strict=True):
                head, n, key = chunk_map(machine, text, i == 0)
                out.append((head, n, _packed(key)))
            made = [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(batch.column(c) for c in names[:4]), *made], ["key", *names])

    def scan(batches):
        machine = transducer(tokenizer)
        for batch in batches:
            cols, n = batch.to_pydict(), []
            for maps_ in cols["maps"]:
                parts: dict[int, list] = {}
                for p in sorted(maps_, key=lambda p: (p["part"], p["i"])):
                    parts.setdefault(p["part"], []).append((p["head"], p["count"], _unpacked(p["exit"])))
                total = len(parts) - 1  # the special strings between parts
                for level in parts.values():
                    while len(level) > 1:  # in pairs, as maps compose associatively
                        level = [compose(machine, *level[j : j + 2]) if j + 1 < len(level) else level[j] for j in range(0, len(level), 2)]
                    total += apply_map(machine, level[0])
                n.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    special = sorted(special_strings(tokenizer), key=len, reverse=True)
    text = F.coalesce(docs[text_col], F.lit(""))
    parts = F.split(text, "|".join(map(re.escape, special)), -1) if special else F.array(text)
    rows = docs.select(docs[id_col].alias("key"), F.monotonically_increasing_id().alias("row"), F.octet_length(text).cast("bigint").alias("n_bytes"), parts.alias("parts"))
    # a text of one chunk is one row; chunks of 0-based place i begin at i * chunk
    each = rows.select("key", "row", "n_bytes", F.posexplode("parts").alias("part", "text"))
    cut = each.select("key", "row", "n_bytes", "part", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / F.lit(chunk)).cast("int") - 1, F.lit(0)))).alias("n"))
    cut = cut.select("key", "row", "n_bytes", F.col("part").cast("bigint").alias("part"), F.col("n").cast("bigint").alias("i"), F.substring("text", F.col("n") * chunk + 1, F.lit(chunk)).alias("text"))
    mapped = cut.mapInArrow(maps, f"key {kind}, row bigint, n_bytes bigint, part bigint, i bigint, head string, count bigint, exit string")
    gathered = mapped.groupBy("key", "row").agg(F.max("n_bytes").alias("n_bytes"), F.collect_list(F.struct("part", "i", "head", "count", "exit")).alias("maps"))
    return gathered.select("key", "n_bytes", "maps").mapInArrow(scan, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
