"""Secret scans: fixed patterns, and Markov models of random strings against identifiers.

Two character-bigram models are trained from labelled samples, one of random
strings (keys, tokens), one of ordinary identifiers. A run of key-like
characters, without what a fixed pattern has taken, is reported when the
log-likelihood ratio of the two, per transition and in all, passes its
thresholds; otherwise each stretch of it that passes the stricter ones is. Runs
of one class of characters (lower case, upper case, digits) are words or numbers
and never reported.

A fifth of the samples is held out from training. It sets the thresholds: a run
must reach what 99 % of the held-out random strings reach, a stretch also more
than any stretch of a held-out identifier.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import bound_batches, table
from factorloom.llm.words import give_back

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "markov")
#: The base patterns.
_ASSIGN = re.compile(r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
#: A run of at least that many characters is what the open-ended pattern and a length test keep.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(128, -1, dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
#: Shorter runs give too little evidence either way.
MIN_RUN = 16
_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9+/_=-]{%d,}" % (MIN_RUN - 1))
#: Log-likelihood ratio of a whole run: the evidence that one secret in about 10 million runs would need.
MIN_TOTAL = 16.0
#: Share of the held-out random strings that must be found.
RECALL = 0.99
#: Rows that samples from a table may have at most.
MAX_SAMPLES = 50_000
#: Characters that join the words of a run.
_JOINTS = "=-_/+"

#: Words that the sample identifiers are made of.
_STEMS = (
    "account address admin article author backup balance buffer button cache calendar callback channel character client cluster "
    "column command comment company config connection container content context controller counter country customer database default "
    "delete description device directory document domain element email endpoint engine error event exception execute export factory "
    "feature filter folder format function gateway generator handler header history identifier image import index information input "
    "instance interface internal iterator keyboard language layout library listener location manager member memory message method "
    "minimum module monitor network notification number object operation option order output package parameter parser password path "
    "payment permission platform player policy position previous process product profile project property protocol provider query "
    "queue reader record reference register release remote report request resource response result return schedule schema search "
    "section security selection sequence server service session setting shipping signature source standard statement status storage "
    "stream string structure subject subscription system table target template temporary thread timeout timestamp tracker transaction "
    "transfer translation update upload user validation value variable vector version warehouse window workflow writer "
    "verantwortung gesellschaft entwicklung wissenschaft aufmerksamkeit developpement gouvernement etablissement environnement "
    "particulierement administracion conocimiento responsabilidad desarrollo informacion international understanding relationship "
    "characteristic recommendation environmental responsibility"
).split()


def labelled_samples(n: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers, ``n`` of each, the same on every run."""
    rng = np.random.default_rng(seed)
    sets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef", ALPHABET[:62] + "-_"]
    random = ["".join(rng.choice(list(sets[k % len(sets)]), rng.integers(16, 48))) for k in range(n)]
    plain = []
    for k in range(n):
        parts = list(rng.choice(_STEMS, rng.integers(2, 5)))
        if k % 5 == 0:
            parts.append(str(rng.integers(0, 2030)))
        style = k % 6
        if style == 0:
            plain.append("_".join(parts))
        elif style == 1:
            plain.append(parts[0] + "".join(p.title() for p in parts[1:]))
        elif style == 2:
            plain.append("-".join(parts))
        elif style == 3:
            plain.append("_".join(parts).upper())
        elif style == 4:
            plain.append("".join(parts))
        else:
            plain.append("/".join(parts))
    return random, plain


def train_markov(samples: Iterable[str], smooth: float = 0.5) -> np.ndarray:
    """Log-probabilities of one character after another (rows: the one before)."""
    k = len(ALPHABET)
    counts = np.full((k, k), smooth)
    for s in samples:
        codes = _CODE[np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8) & 127]
        codes = codes[codes >= 0]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def log_ratio(table_: np.ndarray, run: str) -> float:
    """Log-likelihood ratio of a run of ``ALPHABET`` characters: random over identifier."""
    codes = _CODE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
    return float(table_[codes[:-1], codes[1:]].sum())


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, match) of the fixed patterns: an assignment's start is that of the value, its match begins at the name."""
    spans = []
    low = text.encode("utf-8", "replace").lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [(m.start(2), 0, m.end(2), m.start()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(spans)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; an assignment's span is the value it assigns."""
    return [m[:3] for m in base_matches(text)]


def _uncovered(start: int, end: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a run that no base span covers."""
    for s, _, e in base:
        if e > start and s < end:
            if s > start:
                yield start, s
            start = e
    if start < end:
        yield start, end


@dataclass(frozen=True)
class Model:
    """Log-ratios of transitions, the thresholds, and the shares found of held-out random strings and identifiers."""

    ratios: np.ndarray
    run_ratio: float
    stretch_ratio: float
    recall: float
    false_alarms: float


def fit_model(samples: tuple[list[str], list[str]] | None = None) -> Model:
    """Train on four fifths of (random strings, identifiers), set the thresholds on the others."""
    random, plain = samples or labelled_samples()
    cut = lambda xs, held: [x for x in xs if (zlib.crc32(x.encode()) % 5 == 0) == held]
    ratios = train_markov(cut(random, False)) - train_markov(cut(plain, False))
    mean = lambda xs: [log_ratio(ratios, x) / (len(x) - 1) for x in map(_clean, xs) if len(x) >= MIN_RUN]
    good, bad = mean(cut(random, True)), mean(cut(plain, True))
    run_ratio = max(float(np.quantile(good, 1 - RECALL)) if good else 1.0, max(bad, default=0.0) + 0.1)
    worst = max((_highest(ratios, _clean(x)) for x in cut(plain, True)), default=0.0)
    model = Model(ratios, run_ratio, max(run_ratio, worst + 0.1), 0.0, 0.0)
    share = lambda xs: float(np.mean([bool(random_stretches(x, model)) for x in map(_clean, xs) if len(x) >= MIN_RUN] or [0.0]))
    return Model(ratios, run_ratio, model.stretch_ratio, share(cut(random, True)), share(cut(plain, True)))


def samples_from(table_: DataFrame, text: str = "text", label: str = "is_random", limit: int = MAX_SAMPLES) -> tuple[list[str], list[str]]:
    """Labelled samples of a table, for ``fit_model``: those of least hash where there are more than ``limit`` of them."""
    rows = table_.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).cast("string").alias("t"), F.col(label).cast("boolean").alias("r"))
    n = rows.count()
    if n > limit:  # a hash bound keeps about ``limit`` rows before anything goes to the driver
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int((1 << 30) * limit / n))
    found = sorted({(r.t, r.r) for r in rows.limit(2 * limit).collect()})
    return [t for t, r in found if r], [t for t, r in found if not r]


def _clean(sample: str) -> str:
    return "".join(c for c in sample if c in ALPHABET)


def _mixed(piece: str) -> bool:
    """Whether a piece holds two classes of characters or more."""
    return any(c.islower() for c in piece) + any(c.isupper() for c in piece) + any(c.isdigit() for c in piece) > 1


def _highest(ratios: np.ndarray, run: str) -> float:
    """The highest mean ratio of a stretch of ``MIN_RUN`` characters."""
    if len(run) < MIN_RUN:
        return -np.inf
    codes = _CODE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
    sums = np.concatenate([[0.0], np.cumsum(ratios[codes[:-1], codes[1:]])])
    return float((sums[MIN_RUN - 1 :] - sums[: len(sums) - MIN_RUN + 1]).max()) / (MIN_RUN - 1)


def _best_stretch(steps: np.ndarray, ratio: float) -> tuple[int, int] | None:
    """The stretch of transitions furthest above ``ratio`` that passes both thresholds, if any does."""
    sums = np.concatenate([[0.0], np.cumsum(steps - ratio)])
    low, ends = np.inf, None
    for b in range(MIN_RUN - 1, len(sums)):
        if sums[b - MIN_RUN + 1] < low:
            low, a = sums[b - MIN_RUN + 1], b - MIN_RUN + 1
        if sums[b] >= low and steps[a:b].sum() >= MIN_TOTAL and (ends is None or sums[b] - low > ends[0]):
            ends = (sums[b] - low, a, b)
    return ends and ends[1:]


def random_stretches(run: str, model: Model) -> list[tuple[int, int]]:
    """Stretches of a run that pass the thresholds: the run itself if it does.

    A stretch is extended as far as that raises its total, then to whole
    letter-and-digit words, so that no end of a value is left over.
    """
    found, todo = [], [(0, len(run))]
    if len(run) < MIN_RUN or not _mixed(run):
        return found
    codes = _CODE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
    steps = model.ratios[codes[:-1], codes[1:]]
    if steps.sum() >= MIN_TOTAL and steps.sum() >= model.run_ratio * len(steps):
        return [(0, len(run))]
    while todo:
        start, end = todo.pop()
        best = _best_stretch(steps[start : end - 1], model.stretch_ratio) if end - start >= MIN_RUN else None
        if best is None:
            continue
        a, b = start + best[0], start + best[1] + 1
        a -= int(np.argmax(np.concatenate([[0.0], np.cumsum(steps[start:a][::-1])])))
        b += int(np.argmax(np.concatenate([[0.0], np.cumsum(steps[b - 1 : end - 1])])))
        while a > start and run[a - 1] not in _JOINTS and run[a] not in _JOINTS:
            a -= 1
        while b < end and run[b] not in _JOINTS and run[b - 1] not in _JOINTS:
            b += 1
        if _mixed(run[a:b]):
            found.append((a, b))
        todo += [(start, a), (b, end)]
    return sorted(found)


def find_spans(text: str | None, model: Model) -> tuple[list, list]:
    """The base spans, and those with what the models add beside them."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + _added(text, base, model))


def _added(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """The spans that the models add to the base ones."""
    more = []
    for m in _RUN.finditer(text):
        for start, end in _uncovered(m.start(), m.end(), base):
            piece = text[start:end].rstrip(_JOINTS)
            start += len(piece) - len(piece.lstrip(_JOINTS))
            more += [(start + a, 3, start + b) for a, b in random_stretches(piece.lstrip(_JOINTS), model)]
    return more


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, text: str = "text", samples: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """Add ``secrets``: spans (array of kind, start, end, match) and base (those of the fixed patterns).

    Positions are code points, ends exclusive; spans lie in order of start,
    then kind. ``match`` is where the whole match begins: for an assignment
    its name, else the span's start. Null and empty texts have none; rows that repeat are scanned each;
    a column named ``secrets`` is replaced. One map-side pass. ``samples`` are
    labelled (random strings, identifiers), of a caller's own (``samples_from``)
    or those of ``labelled_samples``.
    """
    model = fit_model(samples)
    span = "array<struct<kind string, start long, end long, match long>>"
    named = lambda found: [{"kind": KINDS[k], "start": s, "end": e, "match": m} for s, k, e, m in found]

    def both(text: str | None) -> tuple[list, list]:
        base = base_matches(text or "")
        return named(base), named(sorted(base + [(*a, a[0]) for a in _added(text or "", [b[:3] for b in base], model)]))

    @F.pandas_udf(f"base {span}, spans {span}")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([both(t) for t in texts], columns=["base", "spans"])

    return docs.withColumn("secrets", scan(F.col(f"`{text}`").cast("string")))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", samples=None) -> DataFrame:
    """Replace every secret in ``text`` by ``mark``; documents stay, null texts too."""
    bound_batches(docs.sparkSession)
    model = fit_model(samples)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redact_text(t, find_spans(t, model)[1], mark) if t else t for t in texts], dtype=object)
            del texts
            give_back()

    return docs.withColumn(text, clean(F.col(f"`{text}`").cast("string")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans. An assignment is written as its whole match, name included."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    place = F.array(*[F.lit(k) for k in KINDS])
    keyed = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["match"].alias("a"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
    text_of = lambda c: F.array_join(F.transform(keyed(c), lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(text_of(F.col("secrets.base")), 256).alias("base_sha256"), text_of(F.col("secrets.spans")).alias("spans"),
    )
