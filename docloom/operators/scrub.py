"""Masking of personal data in whole texts, by two profiles, with recognised entities, audits and chunks.

A profile is a chain of steps over one text. Every value gets one placeholder, numbered by kind, and keeps it wherever it comes
back; nothing is shared between texts, so that a row costs one pass and no shuffle. The main profile numbers the
matches of a step from the last to the first, the worker profile from the first to the last.

Null texts have no row. An empty text has no replacements.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed, text

LABEL_REWRITES = [(text.python(r"(?i)\bPatient Name\b"), "Patient_Name"), (text.python(r"(?i)\bAttending Physician\b"), "Attending_Physician"), (text.python(r"\bDr\.?\s+Dr\.?\b"), "Dr.")]
_VERBS, _STILL = set(fixed.PATIENT_VERBS), {*fixed.PATIENT_VERBS, *fixed.PATIENT_FINDINGS}
_LABELLED_PATIENT = re.compile(text.python(r"(^|[\r\n]\s*)Patient\s+([A-Za-z0-9]{2,}\s+[A-Za-z0-9]{2,})\b").pattern, re.A | re.M)
_INLINE_PATIENTS = [("patient", text.python(r"\bpatient\s+([a-z]{2,})\s+([a-z]{2,})\b")), ("PATIENT", text.python(r"\bPATIENT\s+([A-Z]{2,})\s+([A-Z]{2,})\b"))]
_LAST_FOUR = text.python(r"(?i)\bSSN\s+ending\s+in\s+(\d{4})\b")
_SMUDGED_SSN = text.python(r"\b[lI]\d{2}[-\s]?\d{2}[-\s]?\d{4}\b")
#: The main profile's plain steps: counter, prefix, pattern, and whether they need context detection.
MAIN = [
    ("EMAIL", "EMAIL", fixed.PII["EMAIL"], False), ("PHONE", "PHONE", fixed.PII["PHONE"], False), ("ID", "SSN", fixed.PII["SSN"], False), ("ID", "CARD", fixed.PII["CREDIT_CARD"], False),
    ("ZIP", "ZIP", fixed.PII["ZIPCODE"], False), ("DATE", "DATE", fixed.PII["DATE"], False), ("NAME", "NAME", fixed.SCRUB_NAME, False), ("NAME", "NAME", fixed.TITLED_NAME, False),
    ("ADDRESS", "ADDR", fixed.PII["ADDRESS"], True), ("CITY_STATE", "CITY", fixed.PII["CITY_STATE"], True), ("PO_BOX", "POBOX", fixed.PII["PO_BOX"], True),
]
_MAIN = [(c, p, text.python(x), context) for c, p, x, context in MAIN]
#: A record number after one of its keywords; a name after one of its labels.
MRN = r"(?i)(" + "|".join(fixed.MRN_KEYWORDS) + r")[:\s]+([A-Z0-9]{6,12})\b"
LABELLED = r"(?i)(" + "|".join(fixed.NAME_LABELS) + r")[:\s]+(?:(" + fixed.NAME_TITLES + r")\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"
_MRN, _LABELLED, _TWO_NAMES = text.python(MRN), text.python(LABELLED), text.python(r"\b[A-Z][a-z]{1,}\s+[A-Z][a-z]{1,}\b")
_WORKER = [(c, n, p, text.python(x)) for c, n, p, x in fixed.WORKER]
_CAPS, _HELD, _PAIR = text.python(fixed.ALL_CAPS), re.compile(r"\[[A-Z_]+\d+\]"), text.python(r"\b([A-Z]{2})\b")
_WORKER_LABEL = text.python(r"(?i)(" + "|".join(sorted(fixed.WORKER_LABELS, key=len, reverse=True)) + r")\s*:\s*")
_FORMS = [text.python(x) for x in fixed.LABELLED_FORMS]
_SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+$", re.A)
ENTITIES = ("PER", "LOC", "ORG")
#: Words of the entity type that a text holds, its start and end in the text, and how sure the recogniser is.
Entity = tuple[str, int, int, float]


class Masker:
    """One text on its way: what is masked so far, the numbers given by kind, and what each step found."""

    def __init__(self, content: str):
        self.text, self.found, self.numbers, self.log = content, {}, Counter(), []

    def name(self, counter: str, prefix: str, value: str, form: str = "[{}_{}]") -> bool:
        """Give a value its placeholder; whether it is a new one."""
        if value in self.found:
            return False
        self.numbers[counter] += 1
        self.found[value] = form.format(prefix, self.numbers[counter])
        return True

    def put(self, places: Iterable[tuple[int, int, str]]) -> None:
        """Write texts in place of stretches that do not overlap, in text order."""
        out, at = [], 0
        for start, end, by in places:
            out += [self.text[at:start], by]
            at = end
        self.text = "".join(out) + self.text[at:]

    def backward(self, counter: str, prefix: str, spans: list[tuple[int, int, str]], form: str = "[{}_{}]", around: str = "{}") -> None:
        """Mask spans (start, end, value), numbering from the last one."""
        for _, _, value in reversed(spans):
            self.name(counter, prefix, value, form)
        self.put([(a, b, around.format(self.found[v])) for a, b, v in spans])

    def forward(self, counter: str, step: str, prefix: str, pattern: re.Pattern, keep: Callable[[str], bool] = lambda _: False) -> None:
        """Mask a pattern's matches, numbering from the first one, and note the new values."""
        new, places = [], []
        for m in pattern.finditer(self.text):
            if not keep(m[0]):
                if self.name(counter, prefix, m[0]):
                    new.append(m[0])
                places.append((*m.span(), self.found[m[0]]))
        self.put(places)
        self.log.append((counter, step, new))


def _patients(it: Masker) -> None:
    spans = []
    for m in _LABELLED_PATIENT.finditer(it.text):
        if m[2].split()[1].lower() not in _VERBS:
            value = f"{m[1]}Patient {m[2]}"  # with a single space: what a wider gap leaves over stays in the text
            spans.append((m.start(), m.start() + len(value), value, m[1]))
    for _, _, value, lead in reversed(spans):
        it.name("PATIENT", lead, value, "{}[PATIENT-{}]")
    it.put([(a, b, it.found[v]) for a, b, v, _ in spans])
    for lead, pattern in _INLINE_PATIENTS:
        it.backward("PATIENT", lead, [(*m.span(), m[0]) for m in pattern.finditer(it.text) if m[1].lower() not in _STILL and m[2].lower() not in _STILL], "{} [PATIENT-{}]")


def mask_main(content: str, context: bool = True) -> Masker:
    """The main profile. context: also addresses, places and names after labels."""
    it = Masker(content)
    for pattern, by in LABEL_REWRITES:
        it.text = pattern.sub(by, it.text)
    _patients(it)
    it.backward("ID", "SSN", [(*m.span(), m[1]) for m in _LAST_FOUR.finditer(it.text)], around="SSN ending in {}")
    it.backward("ID", "SSN", [(*m.span(), m[0]) for m in _SMUDGED_SSN.finditer(it.text)])
    for counter, prefix, pattern, needs in _MAIN:
        if context or not needs:
            it.backward(counter, prefix, [(*m.span(), m[0]) for m in pattern.finditer(it.text)])
    it.backward("ID", "MRN", [(*m.span(2), m[2]) for m in _MRN.finditer(it.text)])
    if context:
        it.backward("NAME", "NAME", [s for s in labelled_names(it.text) if _TWO_NAMES.search(s[2])])
    return it


def labelled_names(content: str) -> list[tuple[int, int, str]]:
    """Start, end and value of names after labels, with their titles."""
    out = []
    for m in _LABELLED.finditer(content):
        value = f"{m[2]} {m[3]}" if m[2] else m[3]
        at = m[0].find(value, len(m[1]))
        if at >= 0:
            out.append((m.start() + at, m.start() + at + len(value), value))
    return out


def mask_worker(content: str, acronyms: frozenset[str] = frozenset(fixed.ACRONYMS), states: frozenset[str] = frozenset(fixed.STATES)) -> Masker:
    """The worker profile: more kinds, names in capitals that are no acronyms, and states that stand alone."""
    it = Masker(content)
    for counter, step, prefix, pattern in _WORKER:
        it.forward(counter, step, prefix, pattern)
    it.forward("PER", "ALL_CAPS_SINGLE", "PER", _CAPS, lambda w: w in acronyms or bool(_HELD.fullmatch(w)))
    alone = [m for m in _PAIR.finditer(it.text) if m[1] in states and it.text[max(0, m.start() - 1) : m.start()] not in ("[", "_") and it.text[m.end() : m.end() + 1] != "]"]
    known = set(it.found)
    it.backward("LOC", "STATE", [(*m.span(), m[1]) for m in alone])
    it.log.append(("LOC", "STANDALONE_STATE", list(dict.fromkeys(m[1] for m in reversed(alone) if m[1] not in known))))
    new = [m[2] for m in _MRN.finditer(it.text) if it.name("ID", "MRN", m[2])]
    for value in new:  # a record number goes wherever it stands
        it.text = it.text.replace(value, it.found[value])
    it.log.append(("ID", "MRN_CONTEXTUAL", new))
    places = []
    for m in _WORKER_LABEL.finditer(it.text):
        value = next((f[0].strip() for form in _FORMS if (f := form.match(it.text, m.end()))), None)
        if value and it.name("PER", "PER", value):
            places.append((m.end(), m.end() + len(value), it.found[value], value))
    it.put([p[:3] for p in places])
    it.log.append(("PER", "LABELED_NAME", [p[3] for p in reversed(places)]))
    return it


def smart_chunks(content: str, size: int = 2000) -> list[str]:
    """Whole sentences in chunks of size characters; a longer sentence is a chunk of its own, and the first chunk before it may be empty.

    A sentence runs to its stops and the space after them; the chunks joined are the text."""
    out, now = [], ""
    for sentence in _SENTENCE.findall(content):
        if len(now) + len(sentence) > size:
            out.append(now)
            now = sentence
        else:
            now += sentence
    return [*out, now] if now else out


def mask_entities(it: Masker, recognise: Callable[[str], list[Entity]], least: float = 0.65, size: int = 2000) -> list[str]:
    """Mask what a recogniser finds in the text's chunks, going on with the numbers of its types; what it was nearly sure of, as warnings.

    A recogniser that fails leaves the chunk as it is."""
    out, warnings = [], []
    for chunk in smart_chunks(it.text, size):
        spans: list[Entity] = []
        if chunk.strip() and not re.fullmatch(r"(\s*\[[A-Z_]+\d+\]\s*)+", chunk):
            try:
                spans = list(recognise(chunk))
            except Exception as e:  # noqa: BLE001  patterns alone are the fallback
                warnings.append(f"recogniser failed: {type(e).__name__}")
        warnings += [f"{kind} at {a}-{b}: {score:.2f}" for kind, a, b, score in spans if max(0.5, least - 0.15) < score <= least]
        part, at = [], 0
        for kind, a, b, score in sorted((s for s in spans if s[0] in ENTITIES and s[3] > least), key=lambda s: s[1]):
            part.append(chunk[at:a])
            value = chunk[a:b]
            if not _HELD.fullmatch(value.strip()):
                it.name(kind, kind, value)
                value = it.found[value]
            part.append(value)
            at = b
        out.append("".join(part) + chunk[at:])
    it.text = "".join(out)
    return warnings


class Recogniser:
    """A model that is loaded once in each worker, when the first text needs it; each call has a time limit."""

    loaded: dict[str, Callable] = {}

    def __init__(self, name: str, load: Callable[[], Callable[[str], list[Entity]]], seconds: float = 30.0):
        self.name, self.load, self.seconds = name, load, seconds

    def __call__(self, chunk: str) -> list[Entity]:
        if self.name not in self.loaded:
            self.loaded[self.name] = self.load()
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.loaded[self.name], chunk).result(self.seconds)
        finally:
            pool.shutdown(wait=False)


MASKED = (
    "text string, replacements array<struct<original:string,placeholder:string>>, log array<struct<kind:string,step:string,originals:array<string>>>, warnings array<string>"
)


def scrub(docs: DataFrame, profile: str = "main", patterns: bool = True, context: bool = True, recogniser: Recogniser | None = None, least: float = 0.65) -> DataFrame:
    """doc_id, text (masked), replacements (map), count, log (new values by step, worker profile) and warnings.

    patterns: whether the profile's patterns run; recogniser: a model of entities that runs after them."""
    if profile not in ("main", "worker"):
        raise ValueError(f"no profile {profile}")

    def one(content: str) -> tuple:
        it = Masker(content) if not patterns else mask_main(content, context) if profile == "main" else mask_worker(content)
        warnings = mask_entities(it, recogniser, least) if recogniser else []
        return it.text, [{"original": k, "placeholder": v} for k, v in it.found.items()], [{"kind": k, "step": s, "originals": o} for k, s, o in it.log], warnings

    @F.pandas_udf(MASKED)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["text", "replacements", "log", "warnings"])

    out = docs.where("text is not null").select("doc_id", F.length("text").alias("chars"), run("text").alias("r"))
    return out.select("doc_id", "chars", "r.text", F.map_from_entries("r.replacements").alias("replacements"), F.size("r.replacements").alias("count"), "r.log", "r.warnings")


def chunked(docs: DataFrame, size: int = 2000) -> DataFrame:
    """doc_id, n and chunk: the sentences of each text in chunks of size characters."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: smart_chunks(t, size))

    return docs.where("text is not null").select("doc_id", F.posexplode(run("text")).alias("n", "chunk"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, value and kind of addresses, places, post boxes, record numbers and labelled names."""
    kinds = [(k, text.python(fixed.PII[k])) for k in ("ADDRESS", "CITY_STATE", "PO_BOX")]

    @F.pandas_udf("array<struct<start:int,end:int,value:string,kind:string>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> list[dict]:
            out = [(*m.span(), m[0], k) for k, p in kinds for m in p.finditer(t)] + [(*m.span(2), m[2], "MRN") for m in _MRN.finditer(t)] + [(*s, "NAME") for s in labelled_names(t)]
            return [{"start": a, "end": b, "value": v, "kind": k} for a, b, v, k in out]

        return texts.map(one)

    return docs.where("text is not null").select("doc_id", F.inline(run("text")))


def merged(first: Column, second: Column) -> Column:
    """Two maps of replacements as one; a value of both has the second's placeholder."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def audit(scrubbed: DataFrame) -> DataFrame:
    """Of texts masked by the worker profile: detections in all and by kind, density, characters removed, change of size, mean length."""
    each = scrubbed.select("doc_id", "chars", F.length("text").alias("after"), "log")
    n = F.aggregate("log", F.lit(0), lambda s, x: s + F.size(x["originals"]))
    removed = F.aggregate("log", F.lit(0), lambda s, x: s + F.aggregate(x["originals"], F.lit(0), lambda t, v: t + F.length(v)))
    kinds = F.array_sort(F.array_distinct(F.transform("log", lambda x: x["kind"])))
    of_kind = lambda k: F.aggregate(F.filter("log", lambda x: x["kind"] == k), F.lit(0), lambda s, x: s + F.size(x["originals"]))
    rows = each.select("doc_id", "chars", "after", n.alias("detections"), F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, of_kind(k)))).alias("by_kind"), removed.alias("removed_chars"))
    share = F.coalesce(F.try_divide(F.col("removed_chars") * 100, F.col("chars")), F.lit(0.0))
    mean = F.coalesce(F.try_divide("removed_chars", "detections"), F.lit(0.0))
    half_up = lambda c, k: F.floor(c * k + 0.5) / k
    return rows.select("doc_id", "detections", "by_kind", half_up(share, 100).alias("density_percent"), "removed_chars", (F.col("after") - F.col("chars")).alias("size_change"), half_up(mean, 10).alias("mean_chars"))


def audit_json(scrubbed: DataFrame) -> DataFrame:
    """doc_id and the audit as JSON: the summary and, by step, how often it found something new."""
    entries = scrubbed.select("doc_id", F.transform("log", lambda x: F.struct(x["kind"].alias("patternType"), x["step"].alias("patternName"), F.size(x["originals"]).alias("matchCount"))).alias("entries"))
    summary = audit(scrubbed)
    rows = summary.join(entries, "doc_id")
    return rows.select("doc_id", F.to_json(F.struct(F.struct(*[c for c in summary.columns if c != "doc_id"]).alias("summary"), "entries")).alias("json"))


def placeholder(kind: Column, index: Column) -> Column:
    """A placeholder of a known type; an error for another type or an index below 1."""
    bad = ~kind.isin(fixed.PLACEHOLDER_TYPES) | (index < 1)
    return F.when(bad, F.raise_error(F.lit("no such placeholder"))).otherwise(F.concat(F.lit("["), kind, F.lit("_"), index.cast("string"), F.lit("]")))


def is_placeholder(col: Column) -> Column:
    return col.rlike(r"^\[[A-Z_]+_\d+\]$")


def looks_scrubbed(col: Column) -> Column:
    return col.rlike(fixed.PLACEHOLDER)


def clamped(confidence: Column) -> Column:
    """A confidence between 0 and 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), confidence))
