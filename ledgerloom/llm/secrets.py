"""Secret scans: base patterns, and probabilistic automata inferred from what they find.

The base patterns label credentials all over the corpus. All their distinct
values are counted into one prefix tree per kind, whose statistically compatible
states are merged (Hoeffding bound on the stop and step frequencies, red-blue
order), which leaves a probabilistic automaton of the format; one more is
inferred from half of all distinct ordinary tokens. Every candidate token,
from the shortest labelled length (or ``SHORT``) on, of every text is then scored by the
logarithm of its likelihood under the best credential format against that of
ordinary tokens (but not less than a little below that of uniformly drawn
characters). The margin is set per length: the score that ``HELD_SHARE`` of the
other half of the ordinary tokens stay below, to a grid of ``GRID`` steps per
doubling, and ``MARGIN`` at least.
Tokens beyond it are added as spans of kind ``format``. Base spans always stay.

An automaton tells character classes apart, so values are counted by their shape,
the class of each character, in a written table that every pass reads whole. The
tree is counted some levels at a time. A state is told apart if at least
``REACHED`` values, and one in ``RESOLUTION``, pass it within ``DEEPEST``
characters; another one is taken for the start state. All shapes then run through
the merged automaton, and its probabilities are their steps and stops, rare ones
and those of long values included. Only counts reach the driver: of the states
told apart, of the merged automata, and of grid steps per length class.

Definitions: null texts are empty. Positions are code points, ends exclusive.
Without labelled credentials there are no automata and only base spans.
Repeated rows get equal results; extra columns are ignored, or kept by
``redact``. Very long texts are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import typed
from ledgerloom.llm.textvec import give_back
from ledgerloom.session import materialise

KINDS = ("assign", "access", "hex")
REACHED = 3  # values that pass a state told apart, at least: of fewer, the bound allows any frequency
RESOLUTION = 500  # and the share of all values, as one in so many
LEVELS = 8  # levels of a prefix tree counted in the first pass; each later pass counts twice as many
DEEPEST = 256  # characters of a prefix told apart
GRID = 512  # grid steps per doubling of a margin
PENDING = 100_000  # distinct values or counts a task holds before it hands them on
LONGEST = 1024  # characters of a value an automaton given a list is inferred from
TRAINED = 250_000  # and of the whole list
END = "\n"  # stands behind a value's last character
ALPHA = 0.01
MARGIN = math.log(1000)  # least margin: so many times likelier as a credential
HELD_SHARE = 0.95  # share of the held-out ordinary tokens of a length below its margin; the rest may be credentials
LEAST_HELD = 100  # held-out tokens a length's margin is taken from; neighbouring lengths join until then
SHORT = 16  # candidates start here if all labelled credentials are longer
ALPHABET = 68  # characters a candidate can consist of
DULL = 0.75  # how much less likely than uniformly drawn characters, each, a token may be taken for
KNOWN = 20_000  # scored tokens a task remembers
REDACTED = "[SECRET]"

# Fixed by the contract.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN_LEAST = 6
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def _tokens(least: int) -> re.Pattern:
    return re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{least},}}")


_CANDIDATE = _tokens(_ASSIGN_LEAST)

Span = tuple[int, int, str]


def _mentions(lowered: str) -> bool:
    return any(word in lowered for word in _ASSIGN_WORDS)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the base patterns, by start, then kind."""
    found = []
    if (":" in text or "=" in text) and _mentions(text.lower()):
        found += [(m.start(), m.end(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def candidates(text: str, taken: Iterable[tuple], pattern: re.Pattern = _CANDIDATE) -> list[tuple[int, int, str]]:
    """Tokens that touch no base span."""
    marks = sorted((t[0], t[1]) for t in taken)
    out, k = [], 0
    for m in pattern.finditer(text):
        while k < len(marks) and marks[k][1] <= m.start():
            k += 1
        if not any(a < m.end() and b > m.start() for a, b in marks[k : k + 8]):
            out.append((m.start(), m.end(), m[0]))
    return out


# Character classes: a credential's format tells these apart, not single letters.
def _class(c: str) -> tuple[str, int]:
    if c.isdigit():
        return "0", 10
    if "a" <= c <= "f":
        return "a", 6
    if "g" <= c <= "z":
        return "z", 20
    if "A" <= c <= "F":
        return "A", 6
    if "G" <= c <= "Z":
        return "Z", 20
    return c, 1


_CLASSES = {c: _class(c) for c in map(chr, range(128))}


class Automaton:
    """A deterministic probabilistic automaton over character classes."""

    UNSEEN = 1e-4

    def __init__(self, values: Iterable[str], alpha: float = ALPHA, trained: int = TRAINED):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.steps: list[dict[str, int]] = [{}]
        self.stops = [0]
        self.visits = [0]
        self.least = SHORT  # shorter values are no candidates of this format
        self.other = math.log(self.UNSEEN)
        for value in values:
            trained -= len(value)
            if trained < 0 and self.visits[0]:
                break
            self.least = min(self.least, len(value))
            self._add([_CLASSES.get(c, (c, 1))[0] for c in value[:LONGEST]], len(value) <= LONGEST)
        self._merge_states()
        self._freeze()

    @classmethod
    def of_counts(cls, counts: dict[str, int], told_apart: int, least: int, alpha: float = ALPHA) -> "Automaton":
        """The merged states of a counted prefix tree, for ``told_apart`` passing values at least; ``refit`` sets the probabilities.

        ``counts`` has the passing values of each such prefix of a shape and of
        its children, an end being one of them.
        """
        self = cls([])
        self.bound, self.least = math.sqrt(0.5 * math.log(2 / alpha)), min(SHORT, least)
        apart = [p for p in counts if not p.endswith(END) and counts[p] >= told_apart]
        number = {p: i for i, p in enumerate(sorted({"", *apart}, key=lambda p: (len(p), p)))}
        self.next, self.steps = [{} for _ in number], [{} for _ in number]
        self.stops = [0] * len(number)
        self.visits = [counts.get(p, 0) for p in number]
        for prefix, n in counts.items():
            parent = number.get(prefix[:-1])
            if not prefix or parent is None:
                continue
            if prefix.endswith(END):
                self.stops[parent] = n
            else:
                self.steps[parent][prefix[-1]] = n
                if prefix in number:
                    self.next[parent][prefix[-1]] = number[prefix]
        self._merge_states()
        self._freeze()
        return self

    def steps_of(self, shape: str) -> Iterator[tuple[int, str]]:
        """The states a shape passes, with the step taken from each, the end last."""
        state = 0
        for c in shape:
            yield state, c
            step = self.table[state].get(c)
            state = 0 if step is None else step[0]
        yield state, END

    def refit(self, counts: dict[tuple[int, str], int]) -> None:
        """Probabilities from how often values took each step of ``steps_of``."""
        floor = self.UNSEEN
        visits = [1] * len(self.table)
        for (state, _), n in counts.items():
            visits[state] += n
        # A state keeps its steps; those seen only now lead to the start.
        table: list[dict[str, tuple[int, float]]] = [{} for _ in self.table]
        stops = [0] * len(self.table)
        for (state, c), n in counts.items():
            if c == END:
                stops[state] = n
            else:
                step = self.table[state].get(c)
                table[state][c] = (0 if step is None else step[0], math.log((1 - floor) * n / visits[state] + floor))
        self.table = table
        self.end = [math.log((1 - floor) * k / n + floor) for k, n in zip(stops, visits, strict=True)]

    def _add(self, symbols: list[str], ends: bool) -> None:
        state = 0
        self.visits[0] += 1
        for s in symbols:
            self.steps[state][s] = self.steps[state].get(s, 0) + 1
            if s not in self.next[state]:
                self.next[state][s] = len(self.next)
                self.next.append({})
                self.steps.append({})
                self.stops.append(0)
                self.visits.append(0)
            state = self.next[state][s]
            self.visits[state] += 1
        self.stops[state] += ends

    def _alike(self, a: int, b: int) -> bool:
        """Whether stop and step frequencies agree, here and in all states below."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            nx, ny = self.visits[x], self.visits[y]
            if not nx or not ny:
                continue
            room = self.bound * (1 / math.sqrt(nx) + 1 / math.sqrt(ny))
            if abs(self.stops[x] / nx - self.stops[y] / ny) > room:
                return False
            for s in self.steps[x].keys() | self.steps[y].keys():
                if abs(self.steps[x].get(s, 0) / nx - self.steps[y].get(s, 0) / ny) > room:
                    return False
                if s in self.next[x] and s in self.next[y] and room < 1:
                    todo.append((self.next[x][s], self.next[y][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the prefix tree below ``tree`` to the state ``into``."""
        todo = [(into, tree)]
        while todo:
            x, y = todo.pop()
            self.visits[x] += self.visits[y]
            self.stops[x] += self.stops[y]
            for s, n in self.steps[y].items():
                self.steps[x][s] = self.steps[x].get(s, 0) + n
                if s not in self.next[y]:
                    continue
                if s in self.next[x]:
                    todo.append((self.next[x][s], self.next[y][s]))
                else:
                    self.next[x][s] = self.next[y][s]

    def _merge_states(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(self.visits[t], -t, r, s, t) for r in red for s, t in self.next[r].items() if t not in known]
            if not blue:
                break
            _, _, parent, symbol, state = max(blue)
            for r in red:
                if self._alike(r, state):
                    self.next[parent][symbol] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
        self.red = red

    def _freeze(self) -> None:
        number = {r: i for i, r in enumerate(self.red)}
        self.table, self.end = [], []
        floor = self.UNSEEN
        for r in self.red:
            n = self.visits[r] + 1
            self.table.append({
                s: (number[self.next[r][s]] if s in self.next[r] else 0, math.log((1 - floor) * c / n + floor)) for s, c in self.steps[r].items()
            })
            self.end.append(math.log((1 - floor) * self.stops[r] / n + floor))
        for name in ("next", "steps", "stops", "visits", "red"):
            delattr(self, name)

    def log_likelihood(self, value: str) -> float:
        state, total = 0, 0.0
        for c in value:
            symbol, size = _CLASSES.get(c, (c, 1))
            step = self.table[state].get(symbol)
            if step is None:
                state, log = 0, self.other
            else:
                state, log = step
            total += log - math.log(size)
        return total + self.end[state]


def _length_class(size: int) -> int:
    """Two classes per doubling of the length: 6, 8, 12, 16, 24, 32, 48, ... characters on."""
    top = size.bit_length() - 1
    return 2 * top + (size >> (top - 1) & 1)


def _bounded_class(size: int) -> int:
    return min(_length_class(size), _length_class(LONGEST))


class Formats:
    """The credential automata, the one of ordinary tokens, and the margins their held-out tokens set."""

    def __init__(self, automata: dict[str, Automaton], ordinary: Automaton | None, held: Iterable[str] = ()):
        self.automata, self.ordinary = automata, ordinary
        self.least = min((a.least for a in automata.values()), default=SHORT)
        self.margins = self._margins(Counter(self.place(value) for value in held))

    def place(self, value: str) -> tuple[int, int]:
        """Length class of a held-out token, and the grid step its score reaches; -1 below the least margin."""
        score = self.score(value)
        return _bounded_class(len(value)), -1 if score < MARGIN else math.floor(GRID * math.log2(score)) + 1

    def learn_margins(self, places: dict[tuple[int, int], int]) -> None:
        self.margins = self._margins(places)

    def score(self, value: str) -> float:
        formats = [a for a in self.automata.values() if len(value) >= a.least]
        if not formats or self.ordinary is None:
            return -math.inf
        best = max(a.log_likelihood(value) for a in formats)
        uniform = -len(value) * (math.log(ALPHABET) + DULL)
        return best - max(uniform, self.ordinary.log_likelihood(value))

    def _margins(self, places: dict[tuple[int, int], int]) -> dict[int, float]:
        found: dict[int, Counter[int]] = {}
        for (size, step), n in places.items():
            found.setdefault(size, Counter())[step] += n
        margins = {}
        for c in range(_length_class(_ASSIGN_LEAST), _length_class(LONGEST) + 1):
            near = sorted(found, key=lambda o: (abs(o - c), o))
            taken: Counter[int] = Counter()
            for other in near:
                if taken.total() >= LEAST_HELD:
                    break
                taken.update(found[other])
            below = math.ceil(HELD_SHARE * taken.total())
            for step in sorted(taken):
                below -= taken[step]
                if below <= 0:
                    margins[c] = MARGIN if step < 0 else max(MARGIN, 2.0 ** (step / GRID))
                    break
        return margins

    def margin(self, size: int) -> float:
        return self.margins.get(_bounded_class(size), MARGIN)

    def found(self, text: str, taken: Iterable[tuple], known: dict[str, bool]) -> list[tuple[int, int, str]]:
        """The candidates beyond their margin; ``known`` keeps the answers of short tokens."""
        if not self.automata or self.ordinary is None:
            return []
        out = []
        for a, b, value in candidates(text, taken, _tokens(self.least)):
            beyond = known.get(value)
            if beyond is None:
                beyond = self.score(value) >= self.margin(len(value))
                if len(value) <= LONGEST and len(known) < KNOWN:
                    known[value] = beyond
            if beyond:
                out.append((a, b, value))
        return out


_SPANS = "array<struct<start:bigint,stop:bigint,kind:string,value:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))


_SHAPE = str.maketrans({c: symbol for c, (symbol, _) in _CLASSES.items()})


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The credentials and ordinary tokens of all texts, mostly once per task."""
    found: set[tuple[str, str]] = set()

    def told() -> pa.RecordBatch:
        kinds, values = zip(*found, strict=True) if found else ((), ())
        found.clear()
        return pa.record_batch([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    held = 0
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            base = base_spans(text)
            before = len(found)
            found.update((kind, value) for *_, kind, value in base)
            found.update(("ordinary", value) for _, _, value in candidates(text, base))
            held += len(text) if len(found) > before else 0
            if len(found) >= PENDING or held >= 16 << 20:
                held = 0
                yield told()
        give_back()
    yield told()


def shapes(docs: DataFrame) -> DataFrame:
    """kind, shape, n: how many distinct values of the corpus have it; of ordinary tokens, half are of kind ``held``. Written once."""

    def shape(values: pa.Array) -> pa.Array:
        return pa.array([v.translate(_SHAPE) for v in values.to_pylist()], pa.string())

    found = typed(docs, text="string").select("text").mapInArrow(_labelled, "kind string, value string").distinct()
    held = (F.col("kind") == "ordinary") & (F.crc32(F.encode("value", "UTF-8")) % 2 == 0)
    kind = F.when(held, "held").otherwise(F.col("kind"))
    kinds = found.select(kind.alias("kind"), F.arrow_udf(shape, "string")("value").alias("shape"))
    return materialise(kinds.groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n")))


def _summed(table: DataFrame, keys, kinds: str) -> DataFrame:
    """The sum of n per key that ``keys(kind, shape)`` yields, added up in tasks first."""
    names = [k.split()[0] for k in kinds.split(", ")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def told() -> pa.RecordBatch:
            columns = list(zip(*sums, strict=True)) if sums else [()] * len(names)
            types = {"string": pa.string(), "int": pa.int32()}
            arrays = [pa.array(c, types[k.split()[1]]) for c, k in zip(columns, kinds.split(", "), strict=True)]
            batch = pa.record_batch([*arrays, pa.array(list(sums.values()), pa.int64())], names=[*names, "n"])
            sums.clear()
            return batch

        for batch in batches:
            for kind, shape, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for key in keys(kind, shape):
                    sums[key] += n
                if len(sums) >= PENDING:
                    yield told()
        yield told()

    return table.mapInArrow(add, f"{kinds}, n bigint").groupBy(*names).agg(F.sum("n").alias("n"))


def _trees(table: DataFrame, apart: dict[str, int]) -> dict[str, dict[str, int]]:
    """Per kind: passing values of the prefixes that are told apart, and of their children."""
    counts: dict[str, dict[str, int]] = {kind: {} for kind in apart}
    tips = {(kind, "") for kind in apart}
    start, levels = 0, LEVELS
    while tips and start < DEEPEST:
        levels = min(levels, DEEPEST - start)

        def prefixes(kind: str, shape: str, tips=tips, start=start, levels=levels) -> Iterator[tuple[str, str]]:
            if len(shape) >= start and (kind, shape[:start]) in tips:
                ended = shape[: start + levels] + END * (len(shape) < start + levels)
                for size in range(start + 1, len(ended) + 1):
                    yield kind, ended[:size]

        found = materialise(_summed(table, prefixes, "kind string, prefix string"))
        least = F.lit(None)
        for kind, n in apart.items():
            least = F.when(F.col("kind") == kind, n).otherwise(least)
        frequent = found.where(~F.endswith("prefix", F.lit(END)) & (F.col("n") >= least))
        parents = frequent.select("kind", F.col("prefix").alias("parent"))
        told = found.withColumn("parent", F.expr("left(prefix, length(prefix) - 1)"))
        near = told.where(F.length("parent") == start).unionByName(told.join(parents, ["kind", "parent"], "left_semi").select(told.columns))
        for r in near.collect():
            counts[r["kind"]][r["prefix"]] = r["n"]
        start, levels = start + levels, 2 * levels
        tips = {(k, p) for k, c in counts.items() for p, n in c.items() if len(p) == start and n >= apart[k] and not p.endswith(END)}
    return counts


def infer_formats(docs: DataFrame) -> Formats:
    """Automata and margins from every distinct credential and ordinary token of the corpus."""
    table = shapes(docs)
    sums = table.groupBy("kind").agg(F.sum("n").alias("n"), F.min(F.length("shape")).alias("least")).collect()
    least = {r["kind"]: r["least"] for r in sums}
    shortest = min([SHORT, *(least[k] for k in KINDS if k in least)]) if any(k in least for k in KINDS) else SHORT
    long = table.where(F.col("kind").isin(*KINDS) | (F.length("shape") >= shortest))
    size = {r["kind"]: r["n"] for r in long.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    trained = [k for k in (*KINDS, "ordinary") if k in size]
    if not any(k in KINDS for k in trained):
        return Formats({}, None)
    apart = {k: max(REACHED, size[k] // RESOLUTION) for k in trained}
    automata = {k: Automaton.of_counts({"": size[k], **c}, apart[k], least[k]) for k, c in _trees(long, apart).items()}

    def steps(kind: str, shape: str) -> Iterator[tuple[str, int, str]]:
        if kind in automata:
            for state, c in automata[kind].steps_of(shape):
                yield kind, state, c

    taken: dict[str, dict[tuple[int, str], int]] = {k: {} for k in trained}
    for r in _summed(long, steps, "kind string, state int, step string").collect():
        taken[r["kind"]][r["state"], r["step"]] = r["n"]
    for kind, automaton in automata.items():
        automaton.refit(taken[kind])
    formats = Formats({k: a for k, a in automata.items() if k in KINDS}, automata.get("ordinary"))

    def places(kind: str, shape: str) -> Iterator[tuple[int, int]]:
        if kind == "held":
            yield formats.place(shape)

    formats.learn_margins({(r["size"], r["step"]): r["n"] for r in _summed(long, places, "size int, step int").collect()})
    return formats


def secret_spans(text: Column, formats: Formats) -> Column:
    """start, stop, kind, value of every secret, by start, then base kinds first."""

    def scan(texts: pa.Array) -> pa.Array:
        out = []
        known: dict[str, bool] = {}
        for text in texts:
            text = text.as_py()
            base = base_spans(text or "")
            extra = [(a, b, "format", v) for a, b, v in formats.found(text or "", base, known)]
            rows = sorted(base + extra, key=lambda f: (f[0], (*KINDS, "format").index(f[2])))
            out.append([{"start": a, "stop": b, "kind": k, "value": v} for a, b, k, v in rows])
        given = pa.array(out, _SPAN_TYPE)
        del out
        give_back()
        return given

    return F.arrow_udf(scan, _SPANS)(text.cast("string"))


def secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """doc_id, spans: every secret of every text."""
    formats = formats or infer_formats(docs)
    return typed(docs, doc_id="bigint", text="string").select("doc_id", secret_spans(F.col("text"), formats).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """The counts and digests of ``secrets`` per document."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in KINDS]
    counts = [(F.size(kinds) - c).cast("long").alias(f"n_{k}") for k, c in zip(KINDS, counts, strict=True)]
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by ``REDACTED``; n_chars follows where it exists."""
    formats = infer_formats(docs)

    def replace(texts: pa.Array) -> pa.Array:
        out = []
        known: dict[str, bool] = {}
        for text in texts:
            text = text.as_py()
            if text is None:
                out.append(None)
                continue
            base = base_spans(text)
            spans = [(a, b) for a, b, *_ in base]
            spans += [(a, b) for a, b, _ in formats.found(text, base, known)]
            parts, at = [], 0
            for a, b in sorted(spans):
                if b <= at:
                    continue
                if a >= at:
                    parts += [text[at:a], REDACTED]
                at = b
            out.append("".join([*parts, text[at:]]) if parts else text)
        given = pa.array(out, pa.string())
        del out
        give_back()
        return given

    cleaned = docs.withColumn("text", F.arrow_udf(replace, "string")(docs["text"].cast("string")))
    if "n_chars" in docs.columns:
        changed = F.char_length(F.col("text"))
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned
