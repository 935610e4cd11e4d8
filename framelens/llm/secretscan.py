"""Secret scans: three fixed formats, and formats learned by grammar inference.

Fixed formats (``assign``, ``access``, ``hex``) are found by pattern. Their matches in all documents are
the labelled credentials, of which each kind's ``per_kind`` with the least hashes are learned from, however rare
they are. A kind's credentials are dealt into formats: by the literal prefix that they share (a prefix tree whose
steps are far likelier than chance), else by the least character class that holds them (``CLASSES``). Within a
format the prefix stays literal and the class is one symbol, so that the tree of a random key does not branch at
every character and lengths survive. Per format, a prefix-tree automaton is built over these symbols and its
statistically compatible states are merged (ALERGIA, Carrasco and Oncina 1994: red-blue order, Hoeffding test),
which leaves a small probabilistic automaton. Every unbroken run of 8 or more token characters of every whole
text is a candidate, and so are its parts: without the punctuation at its ends, behind its first ``=``, and
between its ``=`` signs. A candidate becomes a ``learned`` span when its mean log-likelihood per symbol under a
format's automaton is not below that of all but ``miss`` of its credentials, and its likelihood there is higher
than among ordinary tokens (their share of that class, times the class's own automaton). A format that takes more
than ``loose`` of the ordinary tokens, each counted as often as it stands there (say, passwords that are plain
words), and has no literal prefix tells nothing; it is left out and logged. ``learned_recall`` measures what the automata find with no pattern at work.

Edge cases. Null texts are empty and have no spans. A kind with fewer than five distinct credentials in the whole table gives no automaton,
which is logged; neither does a format with fewer than five. Credentials and ordinary tokens over 256 characters are not
learned from (candidates of any length are scored).
Repeated rows and null ids keep their rows. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import logging
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelens.llm.common import bounded_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so the short ones can be passed over at once
SHORTEST = 8  # no label is shorter
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
PART = re.compile(r"[^=]+=*")  # trailing '=' may be padding
EDGE = ".=-"
KINDS = ("assign", "access", "hex", "learned")
LONGEST = 256  # of the strings that are learned from
#: symbol of a character class and its characters, narrow classes first; the last takes the signs of base64 in too
CLASSES = (("δ", "0-9"), ("ω", "a-z"), ("Ω", "A-Z"), ("η", "0-9a-f"), ("μ", "A-Za-z"), ("λ", "0-9a-z"), ("υ", "0-9A-Z"),
           ("α", "0-9A-Za-z"), ("β", "0-9A-Za-z+/_-"))
HOLDS = {c: re.compile(f"[{chars}]*").fullmatch for c, chars in CLASSES}
INSIDE = {c: re.compile(f"[{chars}]").sub for c, chars in CLASSES}
SIGNS = str.maketrans("", "", "+/_.=-")
FEWEST = 5  # strings of a format

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


class Cover:
    """Tells in logarithmic time whether a stretch of text touches none of the spans."""

    def __init__(self, spans: list[Span]):
        inner = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in inner]
        self.reach = [0, *accumulate((b for _, b in inner), max)]  # the furthest end of the first k spans

    def free(self, start: int, end: int) -> bool:
        return self.reach[bisect_left(self.starts, end)] <= start


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in in_order(spans))


def candidates(text: str, shortest: int, skip: Callable[[str], bool] = lambda _: False) -> Iterator[list[Span]]:
    """Per run of token characters the stretches that may be a key, widest first; linear in the text. Runs that ``skip``
    is true of have none."""
    def trims(a: int, b: int) -> Iterator[tuple[int, int]]:
        yield a, b
        part = text[a:b]
        a, b = b - len(part.lstrip(EDGE)), a + len(part.rstrip(EDGE))
        yield a, b

    for m in TOKEN.finditer(text):
        if len(m[0]) < shortest or skip(m[0]):
            continue
        found = [*trims(*m.span())]
        if "=" in m[0]:
            found += trims(m.start() + m[0].index("=") + 1, m.end())
            for p in PART.finditer(text, *m.span()):
                found += trims(*p.span())
        yield [("learned", a, b) for a, b in dict.fromkeys(found) if b - a >= shortest]


def class_of(text: str) -> str:
    """The least class that holds a token's letters and digits. Signs stand for themselves, but in a token of mixed
    letters and digits ``+/_-`` belong to the class."""
    bare = text.translate(SIGNS)
    least = next(c for c, _ in CLASSES if HOLDS[c](bare))
    return "β" if least == "α" and not HOLDS["α"](text.replace(".", "").replace("=", "")) else least


def shape(text: str, prefix: str, symbol: str) -> str:
    """The token with its prefix as it is and every character of the class as the class's symbol."""
    return prefix + INSIDE[symbol](symbol, text[len(prefix):])


def prefixes(strings: list[str], alpha: float = 1e-4) -> set[str]:
    """The literal prefixes of three or more characters that strings of one class share: steps of their prefix tree whose
    share is above one in ten by more than chance allows (Hoeffding)."""
    out, todo = set(), [(strings, 0)]
    while todo:
        group, depth = todo.pop()
        by: dict[str, list[str]] = {}
        for s in group:
            by.setdefault(s[depth:depth + 1], []).append(s)
        least = 0.1 + math.sqrt(math.log(1 / alpha) / (2 * len(group)))
        heavy = {c for c, g in by.items() if c and len(g) / len(group) > least}
        todo += [(by[c], depth + 1) for c in sorted(heavy)]
        if depth >= 3 and sum(len(g) for c, g in by.items() if c not in heavy) >= FEWEST:
            out.add(group[0][:depth])
    return out


def formats_of(strings: list[str]) -> dict[tuple[str, str], list[str]]:
    """(literal prefix or empty, class) -> the strings of that format; formats of fewer than five are left out."""
    by_class: dict[str, list[str]] = {}
    for s in strings:
        by_class.setdefault(class_of(s), []).append(s)
    known = sorted(set().union(*(prefixes(g) for g in by_class.values())), key=lambda p: (-len(p), p))
    by_prefix: dict[str, list[str]] = {}
    for s in strings:
        by_prefix.setdefault(next((p for p in known if s.startswith(p)), ""), []).append(s)
    out: dict[tuple[str, str], list[str]] = {}
    for p, group in by_prefix.items():
        if p and len(group) >= FEWEST:
            rests = {class_of(s[len(p):]) for s in group}
            every = "".join(s[len(p):] for s in group).translate(SIGNS)
            out[p, "β" if "β" in rests else next(c for c, _ in CLASSES if HOLDS[c](every))] = group
        else:
            for s in group:
                out.setdefault(("", class_of(s)), []).append(s)
    return {k: v for k, v in out.items() if len(v) >= FEWEST}


class Automaton:
    """A probabilistic automaton: per state, the visits that end there and those that leave by each symbol."""

    def __init__(self, strings: list[str]):
        self.kinds = len(set().union(*strings)) + 2  # the end and one symbol not seen
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.end = [0]
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                    self.end.append(0)
                at = self.next[at][c]
            self.end[at] += 1

    def visits(self, s: int) -> int:
        return self.end[s] + sum(self.count[s].values())

    def _agree(self, r: int, b: int, slack: float) -> bool:
        """Do the visits of b (a tree below) look like draws from r's distribution, here and further on?"""
        todo = [(r, b)]
        while todo:
            r, b = todo.pop()
            n, m = self.visits(r), self.visits(b)
            if not n or not m:
                continue
            bound = slack * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[r] / n - self.end[b] / m) > bound:
                return False
            for c in self.count[r].keys() | self.count[b].keys():
                if abs(self.count[r].get(c, 0) / n - self.count[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[r] and c in self.next[b]:
                    todo.append((self.next[r][c], self.next[b][c]))
        return True

    def _fold(self, r: int, b: int) -> None:
        """Add the tree below b to r."""
        todo = [(r, b)]
        while todo:
            r, b = todo.pop()
            self.end[r] += self.end[b]
            for c, k in self.count[b].items():
                self.count[r][c] = self.count[r].get(c, 0) + k
                if c in self.next[r]:
                    todo.append((self.next[r][c], self.next[b][c]))
                else:
                    self.next[r][c] = self.next[b][c]

    def merged(self, alpha: float = 0.01) -> Automaton:
        """Merge compatible states, most visited candidates first."""
        slack = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            kept = set(red)
            blue = [(self.visits(t), -t, r, c) for r in red for c, t in self.next[r].items() if t not in kept]
            if not blue:
                return self
            _, b, parent, c = max(blue)
            for r in red:
                if self._agree(r, -b, slack):
                    self.next[parent][c] = r
                    self._fold(r, -b)
                    break
            else:
                red.append(-b)

    def fit_of(self, s: str) -> float:
        """Mean natural log-likelihood per symbol, the end counted as one; unseen steps get a small share."""
        at, total = 0, 0.0
        for c in s:
            total += math.log((self.count[at].get(c, 0) + 0.1) / (self.visits(at) + 0.1 * self.kinds))
            at = self.next[at].get(c, 0)
        return (total + math.log((self.end[at] + 0.1) / (self.visits(at) + 0.1 * self.kinds))) / (len(s) + 1)

    def states(self) -> int:
        """The states that can be reached."""
        seen, todo = {0}, [0]
        while todo:
            new = set(self.next[todo.pop()].values()) - seen
            seen |= new
            todo += new
        return len(seen)


@lru_cache(1 << 16)
def _mark(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Formats:
    """Automata of the credentials' formats with their least likelihoods, and those of ordinary tokens by class."""

    def __init__(self, labelled: dict[str, list[str]], ordinary: Iterable[str] | dict[str, int], miss: float = 0.05, loose: float = 0.01):
        self.shortest = min((len(s) for v in labelled.values() for s in v), default=SHORTEST)
        self.known: dict[tuple[str, str, str], bool] = {}
        times = Counter(ordinary)  # how often each ordinary token stands there
        by_class: dict[str, list[str]] = {}
        for s in times:
            if len(s) <= LONGEST:
                by_class.setdefault(class_of(s), []).append(s)
        #: a class's share of the ordinary tokens and its automaton; a rare class counts as the fewest
        self.usual = {c: (math.log(sum(times[s] for s in g) / times.total()), Automaton([shape(s, "", c) for s in g]).merged())
                      for c, g in by_class.items() if len(g) >= FEWEST}
        self.rare = math.log(FEWEST / (times.total() + FEWEST)) if times else -math.inf
        #: (automaton, kind, prefix, class, least mean log-likelihood)
        self.kinds: list[tuple[Automaton, str, str, str, float]] = []
        for kind in sorted(labelled):
            for (prefix, c), strings in sorted(formats_of([s for s in labelled[kind] if len(s) <= LONGEST]).items()):
                shapes = [shape(s, prefix, c) for s in strings]
                model = Automaton(shapes).merged()
                fits = sorted(map(model.fit_of, shapes))
                self.kinds.append((model, kind, prefix, c, fits[int(miss * len(fits))]))
        self._by_format()
        telling = []
        for form in self.kinds:
            taken = 0 if form[2] else sum(n for s, n in times.items() if self._typical(form, s))
            if taken <= loose * times.total():
                telling.append(form)
            else:
                logging.getLogger(__name__).warning("format %s of %s also takes %d of %d ordinary tokens: left out", form[3], form[1],
                                                    taken, times.total())
        self.kinds = telling
        self._by_format()

    def _by_format(self) -> None:
        self.plain = {c for _, _, prefix, c, _ in self.kinds if not prefix}
        self.words = bool(self.plain & {"ω", "Ω", "μ"})
        self.literal = tuple({prefix for _, _, prefix, _, _ in self.kinds if prefix})

    def _typical(self, form: tuple[Automaton, str, str, str, float], token: str) -> bool:
        """Is the token's likelihood that of the format's credentials, and higher than that among ordinary tokens?"""
        model, _, prefix, c, least = form
        if not token.startswith(prefix) or (not HOLDS[c](token[len(prefix):].translate(SIGNS)) if prefix else class_of(token) != c):
            return False
        form_shape = shape(token, prefix, c)
        fit = model.fit_of(form_shape)
        if fit < least:
            return False
        own = class_of(token)
        share, usual = self.usual.get(own, (self.rare, None))
        if usual:
            share += usual.fit_of(shape(token, "", own)) * (len(token) + 1)
        return fit * (len(form_shape) + 1) > share

    def hopeless(self, run: str) -> bool:
        """Is the run of letters alone (signs at its ends aside), which no format here is of? Tells ``spans`` nothing new,
        but soon: such a run's parts have its class."""
        word = run.strip(EDGE)
        return word.isalpha() and not self.words and not run.startswith(self.literal) and not word.startswith(self.literal)

    def accepts(self, token: str) -> bool:
        c = class_of(token)
        prefix = next((p for p in self.literal if token.startswith(p)), "")
        if not prefix and c not in self.plain:
            return False
        key = (prefix, c, shape(token, prefix, c))
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = any(self._typical(f, token) for f in self.kinds)
        return self.known[key]

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        """Accepted candidates that touch no base span; of overlapping ones the widest."""
        taken, found = Cover(base), []
        for tries in candidates(text, SHORTEST, self.hopeless):
            first, last = len(text), 0  # the accepted ones of this run lie within; parts come in order
            for s in tries:
                if (s[2] <= first or last <= s[1]) and taken.free(s[1], s[2]) and self.accepts(text[s[1]:s[2]]):
                    found.append(s)
                    first, last = min(first, s[1]), max(last, s[2])
        return found


def learn(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 20_000, per_kind: int = 400,
          ordinary: int = 4_000) -> Formats:
    """Automata from the ``per_kind`` credentials a kind that have the least hashes of all documents' credentials, and
    from the ``ordinary`` ordinary tokens of least hashes of about ``sample_docs`` documents chosen by a hash of id and text."""
    bounded_batches(docs.sparkSession)
    n = docs.count()
    mark = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("formats")), F.lit(1_000_000))
    sample = docs.where(mark < math.ceil(1e6 * min(1.0, sample_docs / max(n, 1))))

    def labels(text: str) -> Iterator[tuple[str, str]]:
        yield from (("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8)
        yield from ((k, text[x:y]) for k, x, y in base_spans(text) if k != "assign")

    def least(rows: DataFrame, find: Callable[[str], Iterator[tuple[str, str]]], most: int) -> dict[str, dict[str, int]]:
        """Per kind the distinct values of the least hashes, and how often each occurs: of each task's, then of all tasks'.
        A value among the least of all is among the least of every task from its first occurrence on, so counts are whole."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[str, Counter[tuple[int, str]]] = {}
            for b in batches:
                for text in b["text"]:
                    for kind, value in find(text or ""):
                        best.setdefault(kind, Counter())[_mark(value), value] += 1
                for kind, seen in best.items():
                    if len(seen) > most:
                        best[kind] = Counter({k: seen[k] for k in heapq.nsmallest(most, seen)})
            yield pd.DataFrame([(k, h, v, n) for k, seen in best.items() for (h, v), n in seen.items()], columns=["kind", "hash", "value", "n"])

        found = rows.select(F.col(text_col).alias("text")).mapInPandas(run, "kind string, hash long, value string, n long")
        place = F.row_number().over(Window.partitionBy("kind").orderBy("hash", "value"))
        got: dict[str, dict[str, int]] = {}
        every = found.groupBy("kind", "hash", "value").agg(F.sum("n").alias("n")).withColumn("place", place)
        for r in every.where(F.col("place") <= most).orderBy("kind", "place").collect():
            got.setdefault(r.kind, {})[r.value] = r.n
        return got

    labelled = least(docs, labels, per_kind)
    few = {k: len(labelled.get(k, ())) for k in KINDS[:3] if len(labelled.get(k, ())) < 5}
    if few:
        logging.getLogger(__name__).warning("no automaton for kinds with fewer than 5 distinct credentials: %s", few)
    labelled = {k: list(labelled.get(k, ())) for k in KINDS[:3]}

    def plain(text: str) -> Iterator[tuple[str, str]]:
        taken = Cover(base_spans(text))
        yield from (("ordinary", text[x:y]) for tries in candidates(text, SHORTEST) for _, x, y in tries if taken.free(x, y))

    return Formats(labelled, least(sample, plain, ordinary).get("ordinary", {}))


def scan(docs: DataFrame, formats: Formats | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans): kind, start and end (code points, end exclusive) of the fixed and of all spans."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            base = [base_spans(t or "") for t in b["text"]]
            full = [x + (formats.spans(t or "", x) if formats else []) for t, x in zip(b["text"], base, strict=True)]
            dicts = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in in_order(spans)]
            yield pd.DataFrame({"id": b["id"], "base": list(map(dicts, base)), "spans": list(map(dicts, full))})

    span = "array<struct<kind: string, start: long, end: long>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id long, base {span}, spans {span}").withColumnRenamed("id", id_col)


def learned_recall(docs: DataFrame, formats: Formats, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, credentials, found): per fixed format its credentials in ``docs`` and how many of them the automata find
    (the very span, or a wider one) when no pattern is at work. Meant for documents that ``formats`` was not learned from."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, found = dict.fromkeys(KINDS[:3], 0), dict.fromkeys(KINDS[:3], 0)
        for b in batches:
            for text in b["text"]:
                truth = [("assign", *m.span(2)) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
                truth += [s for s in base_spans(text or "") if s[0] != "assign"]
                spans = formats.spans(text, []) if truth else []
                for kind, x, y in truth:
                    total[kind] += 1
                    found[kind] += any(a <= x and y <= z for _, a, z in spans)
        yield pd.DataFrame({"kind": KINDS[:3], "credentials": total.values(), "found": found.values()})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "kind string, credentials long, found long")
    return rows.groupBy("kind").agg(F.sum("credentials").alias("credentials"), F.sum("found").alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed kinds, the digest of their spans, and all spans as text."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, count("assign"), count("access"), count("hex"),
                        F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def brute_digest(text: str | None) -> tuple[int, int, int, str]:
    """One text's fixed-format digest, straight from the contract's patterns."""
    base = base_spans(text or "")
    n = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
    return n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest()
