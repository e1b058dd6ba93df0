"""Personal data by a semi-Markov conditional random field over base patterns.

The base patterns of four kinds are found first and stay as they are.  What they leave is searched by the model: a candidate
segment is a span of one to `MAX_TOKENS` whitespace-separated tokens, scored as a whole (digit groups, separators, checksums,
at-signs, cue words before it), a pair of segments with at most `NEAR_TOKENS` tokens between them by their kinds, and dynamic
programming over a stretch of tokens jointly chooses boundaries and kinds, a token outside all entities scoring 0.  A segment without a digit, an at-sign or the word dot scores minus infinity, so a stretch reaches
`MAX_TOKENS` tokens around such characters and everything else is outside without being looked at: the result is that of the
whole text.  Chosen segments never overlap base spans.

The weights maximise the conditional likelihood (forward-backward over segments, gradient ascent) on sentences that
`examples` writes from patterns and a seed: labelled entities in forms that the base patterns miss, and dates, versions,
prices, keys and other numbers that are none.  Nothing is learned from the documents.

Defined cases: a null text counts as empty; an empty text has no spans; texts of any length are read whole; overlaps of base
kinds all stay; repeated rows give repeated results; other columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelark.llm.shared import documents, small_batches, text_or_empty, tidy

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, NEAR_TOKENS = 9, 3
#: The base patterns.  An ip can only begin where a run of digits does, which is said so that a run is tried once.
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Cue words by kind.
CUES = {"phone": "phone tel telephone call mobile fax cell telefon tél teléfono".split(), "email": "email mail e-mail contact write correo courriel".split(), "card": "card visa mastercard amex credit karte carte tarjeta".split(), "ip": "ip address host server addr from".split()}
_TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]|(?<=\s)dot(?=\s)", re.I)
#: Groups of digits that numbers of the four languages are written in.
PHONE_SHAPES = frozenset("3-3-4 3-7 4-7 4-3-4 4-8 3-8 3-3-2-2 3-3-2-2-2 4-3-2-2 2-2-2-2-2 3-3-3 2-3-2-2 3-2-2-2 5-6 5-3-3".split())
_TOKEN = re.compile(r"\S+")
_AT = re.compile(r"\s*(?:@|[(\[]at[)\]])\s*", re.I)
#: A dot with a space behind it alone ends a sentence.
_DOT = re.compile(r"\s+\.\s+|(?<!\s)\.(?!\s)|\s*[(\[]dot[)\]]\s*|\s+dot\s+", re.I)
#: An address in words, with its dots and its at: the words of its host are parted by dots in words.
_SPELT = re.compile(r"[A-Za-z0-9_-]+(?:\s+dot\s+[A-Za-z0-9_-]+)*\s+at\s+[A-Za-z0-9-]+(?:\s+dot\s+[A-Za-z0-9-]+)+", re.I)
_NAME, _HOST = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile(r"[A-Za-z0-9-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        host = EMAIL_HOST.match(text, at)
        if host:
            # The local part is the run of its characters before the at-sign, back to the last match at most.
            start = at
            while start > done and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
                start -= 1
            if start < at:
                out.append(("email", start, host.end()))
                done = host.end()
        at = text.find("@", max(at + 1, done))
    if re.search("[0-9]", text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


class Taken:
    """Stretches of a text that spans cover."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start


def segment_features(segment: str, before: str, kind: str) -> list[str] | None:
    """Features of a candidate as a whole; None where the kind rules it out."""
    digits = _digits(segment)
    spelt = kind == "email" and _SPELT.fullmatch(segment)
    if not digits and not spelt and not _AT.search(segment):
        return None
    if not (segment[0].isalnum() or segment[0] in "([+") or not (segment[-1].isalnum() or segment[-1] in ")]"):
        return None
    letters = any(c.isalpha() for c in segment)
    cue = "cue" if any(w.strip(".,:;()").lower() in CUES[kind] for w in before.split()[-2:]) else "nocue"
    if spelt:
        top = segment.split()[-1]
        return ["email", f"email:{cue}", f"email:spelt={min(len(top), 6) if top.isalpha() else 'odd'}", f"email:dots={min(3, len(re.findall('dot', segment, re.I)))}"]
    if kind == "email":
        sides = _AT.split(segment)
        if len(sides) != 2 or not _NAME.fullmatch(sides[0]):
            return None
        hosts = _DOT.split(sides[1])
        if len(hosts) < 2 or not all(_HOST.fullmatch(h) for h in hosts):
            return None
        return ["email", f"email:{cue}", f"email:top={'word' if 2 <= len(hosts[-1]) <= 10 and hosts[-1].isalpha() else 'odd'}"]
    if letters or not digits:
        return None
    groups = [len(g) for g in re.findall(r"[0-9]+", segment)]
    marks = "".join(sorted(set(re.sub(r"[0-9\s]", "", segment)) | ({" "} if re.search(r"\s", segment) else set())))
    if kind == "ip":
        ok = re.fullmatch(r"[0-9]+(\s?\.\s?[0-9]+){3}", segment) and all(int(g) <= 255 for g in re.findall(r"[0-9]+", segment) if len(g) < 6) and max(groups) <= 3
        return ["ip", f"ip:{cue}", f"ip:marks={marks}"] if ok else None
    if kind == "card":
        if not 13 <= len(digits) <= 19 or not luhn(digits):
            return None
        return ["card", f"card:{cue}", f"card:marks={marks}", f"card:even={len(set(groups[:-1])) <= 1 and groups[0] >= 4}"]
    if not 9 <= len(digits) <= 15 or len(groups) > 6:
        return None
    shape = "-".join(map(str, groups))
    led = "zero" if digits[0] == "0" else "plain"
    return ["phone", f"phone:{cue}", f"phone:marks={marks}", f"phone:shape={shape if shape in PHONE_SHAPES else 'other'}", f"phone:{led}:{cue}", f"phone:{led}:groups={min(len(groups), 6)}", f"phone:paren={bool(re.match(r'[(+]', segment))}"]


class SemiMarkov:
    """Whole-segment scores with dynamic programming over stretches of tokens."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights if weights is not None else {}

    def candidates(self, text: str, tokens: list[tuple[int, int]], taken: Taken | list[tuple[int, int]]) -> list[tuple[int, int, str, int, int, list[str]]]:
        """(first token, token after the last, kind, start, end, features) of every segment that isn't ruled out."""
        out, taken = [], taken if isinstance(taken, Taken) else Taken(taken)
        words = [text[a:b] for a, b in tokens]
        triggers = [bool(_TRIGGER.search(f" {w} ")) for w in words]
        letters = [any(c.isalpha() for c in w) for w in words]
        ats = ["@" in w or "at" in w.lower() for w in words]
        for i in range(len(tokens)):
            trigger = letter = at = False
            for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
                trigger, letter, at = trigger or triggers[j - 1], letter or letters[j - 1], at or ats[j - 1]
                # Only an address has letters, and it has an at.
                if letter and not at:
                    if not any(ats[j : i + MAX_TOKENS]):
                        break
                    continue
                if not trigger:
                    continue
                start, end = tokens[i][0], tokens[j - 1][1]
                while end > start and text[end - 1] in ".,;:!?\"'":
                    end -= 1
                while start < end and text[start] in "\"'<":
                    start += 1
                if end <= start or taken.meets(start, end):
                    continue
                before = text[max(0, start - 40) : start]
                for kind in ("email",) if letter else KINDS:
                    if (f := segment_features(text[start:end], before, kind)) is not None:
                        out.append((i, j, kind, start, end, f))
        return out

    def score(self, features: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def pair(self, before: str, kind: str) -> float:
        return self.weights.get(f"pair:{before}>{kind}", 0.0)

    def _before(self, n: int, candidates: list) -> list[list[int]]:
        """For each candidate those that end at most NEAR_TOKENS tokens before it."""
        by_end: dict[int, list[int]] = {}
        for i, c in enumerate(candidates):
            by_end.setdefault(c[1], []).append(i)
        return [[k for e in range(max(0, c[0] - NEAR_TOKENS), c[0] + 1) for k in by_end.get(e, ())] for c in candidates]

    def best(self, n: int, candidates: list) -> list[tuple[str, int, int]]:
        """The segmentation of n tokens with the highest score, as (kind, start, end)."""
        near, total, back = self._before(n, candidates), [0.0] * len(candidates), [-1] * len(candidates)
        # Best of all that ends at a token or before it, and the candidate it ends with.
        top, last, by_end = [0.0] * (n + 1), [-1] * (n + 1), {}
        for i, c in enumerate(candidates):
            by_end.setdefault(c[1], []).append(i)
        for j in range(1, n + 1):
            top[j], last[j] = top[j - 1], last[j - 1]
            for i in by_end.get(j, ()):
                c = candidates[i]
                far = max(0, c[0] - NEAR_TOKENS - 1)
                before, back[i] = top[far], last[far]
                for k in near[i]:
                    if (v := total[k] + self.pair(candidates[k][2], c[2])) > before:
                        before, back[i] = v, k
                total[i] = before + self.score(c[5])
                if total[i] > top[j]:
                    top[j], last[j] = total[i], i
        out, i = [], last[n]
        while i >= 0:
            out.append(candidates[i][2:5])
            i = back[i]
        return out[::-1]

    def expected(self, n: int, candidates: list) -> tuple[float, list[float], dict[tuple[int, int], float]]:
        """Log of the partition function, each candidate's probability, and that of each pair of near ones."""
        near, scores = self._before(n, candidates), [self.score(c[5]) for c in candidates]
        order = sorted(range(len(candidates)), key=lambda i: candidates[i][1])

        def join(values: list[float]) -> float:
            m = max(values)
            return m + math.log(sum(math.exp(v - m) for v in values))

        after: list[list[int]] = [[] for _ in candidates]
        for i, ks in enumerate(near):
            for k in ks:
                after[k].append(i)
        # Of all segmentations that end at a token or before it; with a candidate as the last.
        up, forward, at = [0.0] * (n + 1), [0.0] * len(candidates), 0
        for j in range(1, n + 1):
            here = []
            while at < len(order) and candidates[order[at]][1] == j:
                i = order[at]
                c = candidates[i]
                far = [up[c[0] - NEAR_TOKENS - 1]] if c[0] > NEAR_TOKENS else [0.0]
                forward[i] = scores[i] + join(far + [forward[k] + self.pair(candidates[k][2], c[2]) for k in near[i]])
                here.append(forward[i])
                at += 1
            up[j] = join([up[j - 1], *here])
        # Of all that begin at a token or after it; behind a candidate.
        down, backward = [0.0] * (n + 2), [0.0] * len(candidates)
        by_start: dict[int, list[int]] = {}
        for i, c in enumerate(candidates):
            by_start.setdefault(c[0], []).append(i)
        done = [False] * len(candidates)

        def behind(i: int) -> float:
            if not done[i]:
                to = candidates[i][1] + NEAR_TOKENS + 1
                backward[i] = join([down[to] if to <= n else 0.0] + [self.pair(candidates[i][2], candidates[k][2]) + scores[k] + behind(k) for k in after[i]])
                done[i] = True
            return backward[i]

        for j in range(n - 1, -1, -1):
            down[j] = join([down[j + 1], *(scores[i] + behind(i) for i in by_start.get(j, ()))])
        z = up[n]
        pairs = {(k, i): math.exp(forward[k] + self.pair(candidates[k][2], candidates[i][2]) + scores[i] + backward[i] - z) for i, ks in enumerate(near) for k in ks}
        return z, [math.exp(f + b - z) for f, b in zip(forward, backward, strict=True)], pairs

    def fit(self, labelled: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> SemiMarkov:
        data = []
        for text, gold in labelled:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            found = self.candidates(text, tokens, [s[1:] for s in base_spans(text)])
            right = [c[2:5] in gold for c in found]
            chosen = sorted((i for i, y in enumerate(right) if y), key=lambda i: found[i][0])
            follow = {(a, b) for a, b in zip(chosen, chosen[1:], strict=False) if found[b][0] - found[a][1] <= NEAR_TOKENS}
            data.append((len(tokens), found, right, follow))
        for _ in range(rounds):
            gradient: dict[str, float] = {}
            for n, found, right, follow in data:
                _, each, pairs = self.expected(n, found)
                for c, p, y in zip(found, each, right, strict=True):
                    if y - p:
                        for f in c[5]:
                            gradient[f] = gradient.get(f, 0.0) + y - p
                for (a, b), p in pairs.items():
                    f = f"pair:{found[a][2]}>{found[b][2]}"
                    gradient[f] = gradient.get(f, 0.0) + ((a, b) in follow) - p
            for f, g in gradient.items():
                self.weights[f] = self.weights.get(f, 0.0) * (1 - decay) + rate * g / math.sqrt(len(data))
        return self

    def added_spans(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Entities outside the base spans."""
        taken = Taken([s[1:] for s in base])
        out, reach = [], -1
        for m in _TRIGGER.finditer(text):
            if m.start() < reach or taken.meets(m.start(), m.start() + 1):
                continue
            start, end = m.start(), m.end()
            for _ in range(MAX_TOKENS + NEAR_TOKENS):
                while start > 0 and text[start - 1].isspace():
                    start -= 1
                while start > 0 and not text[start - 1].isspace():
                    start -= 1
            last, k = end, 0
            for t in _TOKEN.finditer(text, start):
                # The stretch goes on until no later segment can be near one of its own.
                if t.end() > m.start():
                    k = 0 if _TRIGGER.search(t[0]) else k + 1
                last = t.end()
                if k >= 2 * MAX_TOKENS + NEAR_TOKENS:
                    break
            reach = last
            tokens = [t.span() for t in _TOKEN.finditer(text, start, last)]
            out += self.best(len(tokens), self.candidates(text, tokens, taken))
        return sorted(set(out))


def examples(n: int = 600, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Labelled sentences: entities that the base patterns miss, and numbers that are none."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8)))

    def number(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = number(15)
        d += next(x for x in "0123456789" if luhn(d + x))
        return r.choice([" . ", "."]).join(d[i : i + 4] for i in range(0, 16, 4))

    def entity() -> tuple[str, str]:
        kind = r.choice(["phone", "phone", "phone", "email", "email", "card", "ip"])
        if kind == "phone":
            a, b, c, two = number(3), number(3), number(4), [number(2) for _ in range(4)]
            near = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"({a}) {b} {c}", f"{a}.{b}.{c}", f"({a}){b}-{c}"]
            far = [f"01{two[0]} {number(7)}", f"0{two[0]} / {a} {' '.join(two[1:])}", f"0{two[0]}/{number(7)}", f"06 {' '.join(two)}", f"0{r.randint(1, 9)} {' '.join(two)}", f"6{two[0]} {a} {b}", f"9{r.randint(1, 9)} {a} {two[0]} {two[1]}", f"0{two[0]}-{number(8)}", f"01{two[0]}-{number(7)}"]
            return kind, r.choice(near + far)
        if kind == "email":
            at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", "."), ("(at)", "."), (" at ", " dot "), (" at ", " dot ")])
            inner = r.choice([" dot ", ""]) if at == " at " else r.choice([".", "", "_"])
            return kind, f"{word()}{inner}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"
        if kind == "card":
            return kind, card()
        return kind, r.choice([" . ", " ."]).join(str(r.randint(1, 255)) for _ in range(4))

    def other() -> str:
        return r.choice([f"{number(4)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{number(2)},{number(3)}.{number(2)}", f"{number(4)} {number(4)} {number(4)}", number(r.randint(1, 12)), number(r.randint(9, 18)), f"{number(3)}-{number(6)}", f"{number(2)} {number(3)} {number(2)} {number(4)}", f"ISBN {number(3)}-{number(1)}-{number(5)}-{number(3)}-{number(1)}", f"{number(2)}:{number(2)}:{number(2)}.{number(3)}", f"{number(5)}-{number(4)}", f"{word()}@{word()}", f"@ {word()}", f"{word()} dot {word()}", f"at {word()} dot", f"{number(2)} / {number(2)} / {number(4)}", f"{number(1)} . {number(2)} . {number(1)}", f"{number(3)} {number(3)}"])

    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(1, 6))), []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.45:
                kind, s = entity()
                if r.random() < 0.4:
                    text += " " + r.choice(CUES[kind]) + r.choice(["", ":"])
                gold.append((kind, len(text) + 1, len(text) + 1 + len(s)))
                text += " " + s
            else:
                text += " " + other()
            text += r.choice(["", ",", "."]) + " " + " ".join(word() for _ in range(r.randint(1, 5)))
        out.append((text, gold))
    return out


@functools.cache
def trained() -> SemiMarkov:
    return SemiMarkov().fit(examples())


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find_personal_data(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans of documents (doc_id, text)."""
    small_batches(docs.sparkSession)
    weights = (model or trained()).weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = SemiMarkov(weights)
        for batch in batches:
            counts, digests, spans, added, totals = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if _TRIGGER.search(text) else []
                more = found.added_spans(text, base) if _TRIGGER.search(text) else []
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base + more))
                added.append(len(more))
                totals.append(len(base) + len(more))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.record_batch([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(totals, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


QUERIES = {"op5_pii": op5_pii}
SQL: dict[str, str] = {}
