"""Masking, records, extractors, narratives, timelines, corpora, pages and sinks on small fixtures."""

import datetime
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import catalog
from docloom.functions import errors, log, text
from docloom.operators import corpus, extraction, labs, master, narrative, quality, reports, scrub, semantic, whitelist
from docloom.plans import compression
from docloom.sources import files, pages, sinks

DAY = datetime.date(2025, 6, 1)


def texts(spark, *each):
    return spark.createDataFrame(list(enumerate(each)), "doc_id bigint, text string")


# masking


@pytest.mark.parametrize(
    "given,want",
    [
        ("Patient Name: John Smith", "Patient_Name: [NAME_1]"),
        ("Patient  Mary Jones came", "[PATIENT-1]s came"),  # a wide gap leaves the end of the name over
        ("x\nPatient Mary Jones came", "x\n[PATIENT-1] came"),
        ("Patient john has pain", "Patient john has pain"),
        ("Patient John has pain", "[NAME_1] has pain"),
        ("the patient john doe and patient reports pain", "the patient [PATIENT-1] and patient reports pain"),
        ("PATIENT JANE ROE", "PATIENT [PATIENT-1]"),
        ("SSN ending in 1234", "SSN ending in [SSN_1]"),
        ("l23-45-6789 I23456789", "[SSN_2] [SSN_1]"),
        ("4785380592391139", "[PHONE_1]391139"),  # a telephone number is taken out of a card's before it is a card's
        ("zip 78704-1234", "zip [SSN_1]"),
        ("on 1/2/2020, not 2024-01-05", "on [DATE_1], not 2024-01-05"),
        ("Member ID required", "Member ID [MRN_1]"),
        ("Dr. Dr. Jane Roe", "Dr.. [NAME_1]"),
        ("Nurse: Mr. Al Bo", "Nurse: [NAME_1]"),
        ("lives at 12 Main Street", "lives at 12 [NAME_1]"),
        ("at 12 main street, Austin, TX, P.O. Box 12", "at [ADDR_1], [CITY_1], [POBOX_1]"),
        ("", ""),
    ],
)
def test_main_profile(given, want):
    assert scrub.mask_main(given).text == want


@pytest.mark.parametrize(
    "given,want",
    [
        ("JOHN SMITH and COMPLETE BLOOD COUNT", "[PER_1] and [PER_2]"), ("CBC and MRI ordered by SMITH", "CBC and MRI ordered by [PER_1]"), ("age 45, a 45 year old", "[AGE_2], a [AGE_1]"),
        ("OR; IN or ME", "[STATE_3]; [STATE_2] or [STATE_1]"), ("Doe, Jane Ann", "[PER_1]"), ("O'Neil-Smith", "[PER_1]"), ("John Smith Jr.", "[PER_1]."), ("born January 5th, 2020", "born [DATE_1]"),
        ("member # 123456789", "[ID_1]"), ("MRN: AB12345, again AB12345", "MRN: [MRN_1], again [MRN_1]"), ("Name: Mary Ann Lee", "Name: [PER_1]"), ("", ""),
    ],
)
def test_worker_profile(given, want):
    assert scrub.mask_worker(given).text == want


def test_scrub_rows_entities_and_audit(spark):
    df = texts(spark, "Call 555-010-0001 or 555-010-0001", None, "", "JOHN SMITH was here. He lives in Austin now.")
    rows = {r.doc_id: r for r in scrub.scrub(df, "worker").collect()}
    assert rows.keys() == {0, 2, 3} and rows[0].text == "Call [PHONE_1] or [PHONE_1]" and rows[0]["count"] == 1 and rows[0].replacements == {"555-010-0001": "[PHONE_1]"}
    audit = {r.doc_id: r for r in scrub.audit(scrub.scrub(df, "worker")).collect()}
    assert (audit[0].detections, audit[0].by_kind["PHONE"], audit[0].removed_chars, audit[0].size_change, audit[0].mean_chars) == (1, 1, 12, -6, 12.0)
    assert audit[0].density_percent == 36.36 and audit[2].density_percent == 0
    assert '"patternName":"ALL_CAPS_NAME","matchCount":1' in scrub.audit_json(scrub.scrub(df, "worker")).where("doc_id = 3").first().json

    def load():
        def model(chunk):
            if "here" not in chunk:
                raise RuntimeError("no")
            at = chunk.find("Austin")
            return [("LOC", at, at + 6, 0.9), ("PER", 0, 2, 0.6), ("ORG", 0, 2, 0.4)]

        return model

    found = {r.doc_id: r for r in scrub.scrub(df, "worker", recogniser=scrub.Recogniser("test", load)).collect()}
    assert found[3].text == "[PER_1] was here. He lives in [LOC_1] now." and found[3].warnings == ["PER at 0-2: 0.60"] and found[0].warnings == ["recogniser failed: RuntimeError"]
    assert scrub.scrub(df, patterns=False).where("doc_id = 0").first().text.startswith("Call 555")
    with pytest.raises(ValueError):
        scrub.scrub(df, "other")


def test_slow_recogniser_is_given_up():
    import time

    it = scrub.Masker("some text")
    assert scrub.mask_entities(it, scrub.Recogniser("slow", lambda: lambda _: time.sleep(3), 0.05)) == ["recogniser failed: TimeoutError"] and it.text == "some text"


def test_sentence_chunks():
    for content in ("One. Two! Three?", "no stop at all", "", "a" * 50 + ". b. " + "c" * 30, "x.y.z..."):
        for size in (1, 8, 40):
            got = scrub.smart_chunks(content, size)
            assert "".join(got) == content
            assert all(len(c) <= size or scrub._SENTENCE.findall(c) == [c] for c in got)
    assert scrub.smart_chunks("abc. d.", 2)[0] == ""


def test_placeholders(spark):
    df = spark.createDataFrame([("PER", 1, "[PER_1]"), ("SSN", 12, "PER_1")], "k string, i int, t string")
    got = df.select(scrub.placeholder(F.col("k"), F.col("i")).alias("p"), scrub.is_placeholder(F.col("t")).alias("is"), scrub.looks_scrubbed(F.col("t")).alias("looks"), scrub.clamped(F.col("i") * 60).alias("c")).collect()
    assert [tuple(r) for r in got] == [("[PER_1]", True, True, 60), ("[SSN_12]", False, False, 100)]
    with pytest.raises(Exception, match="no such placeholder"):
        df.select(scrub.placeholder(F.lit("PER"), F.lit(0))).collect()
    spans = {(r.kind, r.value) for r in scrub.spans(texts(spark, "MRN: AB12345 Doctor: Jane Roe, at 12 main street, P.O. Box 9, Austin, TX")).collect()}
    assert spans == {("MRN", "AB12345"), ("NAME", "Jane Roe"), ("ADDRESS", "12 main street"), ("PO_BOX", "P.O. Box 9"), ("CITY_STATE", "Austin, TX")}


# records


def test_record_of_a_note(spark):
    note = (
        "CT scan of the chest 3/4/2021\nWBC: 3.0 K/uL, Troponin <0.01 ng/mL, HbA1c: 13 %\nTylenol 500 mg PO daily, Tylenol 500 mg, Johnson 5 mg, foobar 5 mg\ndiagnosed with severe heart failure\n"
        "Diagnosis: C34.1 - Lung cancer, call 555-010-0001 or 555-010-0002\nBP: 120/80 Pain: 3\nFindings: a mass of 3 cm in the lung\n"
    )
    r = whitelist.records(texts(spark, note, None, ""), "2025-06-01", guard=True).collect()
    a, b = sorted(r, key=lambda x: x.doc_id)
    assert [(x.test, x.value, x.unit, x.status) for x in a.labs] == [("WBC", "3.0", "K/uL", "Low"), ("HbA1c", "13", "%", "Critical")]
    assert a.warnings == ["Could not parse numeric value: <0.01 in: Troponin <0.01 ng/mL"]
    assert [(x.name, x.dose, x.route, x.frequency) for x in a.medications] == [("Tylenol", "500", "oral", "daily"), ("foobar", "5", None, None)]
    assert [(x.condition, x.icd10, x.severity) for x in a.diagnoses] == [("Lung cancer, call [PHONE] or 555-010-0002", "C34.1", "unspecified"), ("severe heart failure", None, "severe")]
    assert a.leaks == ["phone"] and a.imaging.modality == "ct" and a.vitals.systolic == 120 and a.vitals.pain == 3 and a.document_type == "imaging" and a.document_date == "3/4/2021"
    assert a.confidence == 97 and (b.confidence, b.hash, b.labs) == (30, "00000000", [])
    s = whitelist.statistics(texts(spark, note, None, ""), whitelist.records(texts(spark, note, None, ""), "2025-06-01")).first()
    assert tuple(s) == (3, 2, 1, 2, 2, 2)


def test_simple_hash(spark):
    def one(t):
        h = 0
        units = t.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h * 31 + units[i] + 256 * units[i + 1]) & 0xFFFFFFFF
        return f"{abs(h - (1 << 32) if h >> 31 else h):08x}"

    given = ["", "a", "hello world", "é😀" * 30, "long text " * 20_000]
    assert [r.h for r in texts(spark, *given).orderBy("doc_id").select(whitelist.simple_hash("text").alias("h")).collect()] == [one(t) for t in given]


def test_masks_of_records_stop_at_the_first(spark):
    df = texts(spark, "a@b.org a@c.org 1/2/2020 3/4/2020 Dr. Jane Roe")
    assert df.select(reports.masked(F.col("text")).alias("t")).first().t == "[EMAIL] a@c.org [DATE] [DATE] [NAME]"


def test_timeline_of_records(spark, tmp_path):
    docs = texts(spark, "WBC: 8.0 K/uL on 2024-01-02, lab\nmetformin 500 mg PO BID", "WBC: 12.0 K/uL lab of 2024-01-05\ndiagnosed with heart failure", "nothing", None)
    found = whitelist.records(docs, "2025-06-01")
    sections = whitelist.markdown(docs, found, "2025-06-01")
    whole = "\n".join(r.markdown for r in sections.orderBy("section", "place", "nth").collect())
    assert whole.index("24-01-02 | LAB REPORT") < whole.index("24-01-05 | LAB REPORT") < whole.index("Unknown Date | UNKNOWN")
    assert "- WBC: 8.0 → 12.0 (↑ 50.0%)" in whole and "- metformin 500 mg — BID" in whole and "### 🎯 Active Diagnoses\n\n- heart failure" in whole and "| WBC | 12.0 K/uL | 4-11 | ⬆️ High |" in whole
    assert "- **Date Range**: 24-01-02 → 24-01-05\n- **Total Documents**: 3\n- **Document Types**:\n  - 🧪 lab report: 2\n  - 📄 unknown: 1" in whole and "- Failed extractions: 1" in whole
    whitelist.write(sections, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == len(whole.split("\n"))
    none = whitelist.markdown(docs.where("doc_id = 2"), found.where("doc_id = 2"), "2025-06-01")
    assert {r.markdown for r in none.collect()} >= {"_No active diagnoses extracted_", "_No active medications extracted_"}


# extractors


def test_first_labs(spark):
    df = texts(spark, "HCT 39 % K 2.9 mEq/L K 5.2 mEq/L WBC 3 K/µL", "ALT: 90 U/L", "no unit WBC 5", None)
    got = [(r.doc_id, r.test, r.value, r.unit, r.status) for r in labs.labs(df).orderBy("doc_id", "idx").collect()]
    assert got == [(0, "WBC", "3", "K/µL", "Low"), (0, "HCT", "39", "9", "Normal"), (0, "POTASSIUM", "2.9", "mEq/L", "Critical"), (0, "POTASSIUM", "5.2", "mEq/L", "High"), (1, "ALT", "90", "U/L", "High")]
    order = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "doc_id bigint, place bigint")
    rows = labs.labs(texts(spark, "WBC 5 K/uL BUN 0 mg/dL", "WBC 6 K/uL BUN 5 mg/dL BUN 7 mg/dL", "WBC 6.3 K/uL"))
    assert [r.line for r in labs.changes(rows, order).orderBy("doc_id", "idx").collect()] == ["- **WBC**: 5 → 6 (↑ 20.0%)", "- **BUN**: 0 → 5 (↑ Infinity%)", "- **BUN**: 0 → 7 (↑ Infinity%)", "- WBC: 6 → 6.3 (↑ 5.0%)"]


def test_second_extractor(spark):
    note = "Lisinopril 10 mg PO daily\nlisinopril and atorvastatin 20 mg\nLisinopril 5 mg lorazepam\nthe late one"
    meds = extraction.medications(texts(spark, note)).orderBy("line_no", "nth").collect()
    assert [(m.name, m.dose, m.route, m.frequency, m.confidence) for m in meds] == [("Lisinopril", "10 mg", "PO", "DAILY", 0.7), ("and atorvastatin", "20 mg", "UNKNOWN", "UNKNOWN", 0.7), ("late", None, "UNKNOWN", "UNKNOWN", 0.5)]
    dx = extraction.diagnoses(texts(spark, "before\nPrimary Dx: Pneumonia J18.9\nAssessment:\n1. COPD\nok\nPLAN:\nafter\nDischarge Diagnosis: Asthma\n- well")).orderBy("line_no").collect()
    assert [(d.diagnosis, d.icd10, d.kind, d.confidence) for d in dx] == [("Pneumonia", "J18.9", "PRIMARY", 0.9), ("COPD", None, "PRIMARY", 0.7), ("Asthma", None, "DISCHARGE", 0.8), ("well", None, "DISCHARGE", 0.7)]
    v = extraction.vitals(texts(spark, "BP 150/80 HR 55 Temp 39.0 C SpO2 93% Weight 180 lbs Pain 4/10")).orderBy("nth").collect()
    assert [(x.sign, x.value, x.unit, x.status) for x in v] == [
        ("BP_SYSTOLIC", 150, "mmHg", "ABNORMAL"), ("BP_DIASTOLIC", 80, "mmHg", "NORMAL"), ("HEART_RATE", 55, "bpm", "ABNORMAL"), ("TEMPERATURE", 39, "°C", "ABNORMAL"), ("SPO2", 93, "%", "ABNORMAL"), ("WEIGHT", 180, "lbs", None), ("PAIN_SCALE", 4, "/10", None),
    ]
    i = extraction.imaging(texts(spark, "CT of the chest shows a mass.\nIMPRESSION: nodule\n\n" + "word " * 30 + "used " + "petition")).orderBy("nth").collect()
    assert [(x.modality, x.body_part, x.finding, x.abnormal, x.confidence) for x in i] == [
        ("CT", "chest", "nodule", True, 0.8), ("ULTRASOUND", "unspecified", "ULTRASOUND unspecified performed", False, 0.5), ("PET", "unspecified", "PET unspecified performed", False, 0.5),
    ]


def test_all_facts_and_confidence(spark):
    notes = texts(spark, "WBC 7.5 K/uL (4-11)\nlorazepam\nBP 120/80\nPrimary Dx: Pneumonia J18.9", "", None)
    found = extraction.extract_all(notes, extraction.Config(least=0.6))
    assert found["medications"].count() == 0 and found["labs"].count() == 1 and found["trends"].first().trend == "INSUFFICIENT_DATA"
    s = {r.doc_id: r for r in extraction.summary(notes, extraction.extract_all(notes)).collect()}
    assert (s[0].labs, s[0].medications, s[0].vitals, s[0].diagnoses, s[0].facts, s[0].low_confidence, s[0].low_percent) == (1, 1, 2, 1, 5, 1, "20.0%") and (s[1].facts, s[1].low_percent) == (0, "0%") and s.keys() == {0, 1}


@pytest.mark.parametrize(
    "verbosity,want",
    [
        ("MINIMAL", "Dx:\nFlu, COPD\n\nMeds:\n6 active medications\n\nLabs:\n2 abnormal lab(s)\n\nVS:\nBP 120/80, HR 70\n\nImg:\n1 abnormal imaging finding(s)\n\nTrends:\n1 trending lab value(s)"),
        ("BRIEF", "Diagnoses:\nPrimary: Flu (J10)\nSecondary: 1 additional diagnoses\n\nMedications:\n• d0 PO\n• d1 5 mg PO\n• d2 5 mg PO\n• d3 5 mg PO\n• d4 5 mg PO BID\n... and 1 more\n\nLabs:\n• A: 1.5 u ⚠️\n• B: 2 u (L)\n\nVitals:\nBP 120/80, HR 70\n\n"
         "Imaging:\n• CT chest: Abnormal ⚠️\n\nTrends:\n• A: ↑ increasing"),
        ("DETAILED", "Diagnosis List:\nPrimary: Flu (J10)\n• COPD\n\nMedication List:\n• d0 PO\n• d1 5 mg PO\n• d2 5 mg PO\n• d3 5 mg PO\n• d4 5 mg PO BID\n• d5 5 mg PO\n\nLaboratory Results:\n• A: 1.5 u ⚠️\n• B: 2 u (L)\n• C: 3 u\n\nVital Signs:\nBP 120/80, HR 70\n\n"
         "Imaging Studies:\n• CT chest: mass ⚠️\n\nLaboratory Trends:\n• A: ↑ increasing"),
    ],
)
def test_narratives(spark, verbosity, want):
    rows = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.lit(1000).alias("input_chars"),
        F.expr("array(struct('Flu' as diagnosis, 'PRIMARY' as kind, 'J10' as icd10), struct('COPD' as diagnosis, 'UNKNOWN' as kind, cast(null as string) as icd10))").alias("diagnoses"),
        F.expr("transform(sequence(0, 5), i -> struct(concat('d', i) as name, if(i = 0, cast(null as string), '5 mg') as dose, 'PO' as route, if(i = 4, 'BID', 'UNKNOWN') as frequency, 'ACTIVE' as status))").alias("medications"),
        F.expr("array(struct('A' as test, 1.5D as value, 'u' as unit, 'CRITICAL_HIGH' as status), struct('B' as test, 2D as value, 'u' as unit, 'LOW' as status), struct('C' as test, 3D as value, 'u' as unit, 'NORMAL' as status))").alias("labs"),
        F.expr("array(struct('BP_SYSTOLIC' as sign, 120D as value, 'NORMAL' as status), struct('BP_DIASTOLIC' as sign, 80D as value, 'NORMAL' as status), struct('HEART_RATE' as sign, 70D as value, 'NORMAL' as status))").alias("vitals"),
        F.expr("array(struct('CT' as modality, 'chest' as body_part, 'mass' as finding, cast(null as string) as impression, true as abnormal))").alias("imaging"),
        F.expr("array(struct('A' as test, 'INCREASING' as trend), struct('B' as test, 'STABLE' as trend))").alias("trends"),
    )
    r = narrative.generate(rows, narrative.Config(verbosity=verbosity)).first()
    assert r.narrative == want and (r.n_labs, r.n_abnormal, r.n_imaging) == (3, 2, 1) and r.ratio == 1 - len(want) / 1000
    assert [(s.kind, s["items"], s.abnormal) for s in r.sections] == [("DIAGNOSES", 2, False), ("MEDICATIONS", 6, False), ("LABS", 3, True), ("VITALS", 3, False), ("IMAGING", 1, True), ("TRENDS", 2, True)]
    cut = narrative.generate(rows, narrative.Config(verbosity=verbosity, most=50, most_section=20)).first()
    assert len(cut.narrative) == 50 and cut.narrative.endswith("...") and all(len(s.content) <= 20 for s in cut.sections)


def test_narrative_of_notes(spark):
    notes = texts(spark, "WBC 17.5 K/uL H\nmetformin 500 mg PO BID\nBP 120/80", "nothing", None)
    r = {x.doc_id: x for x in narrative.generate(narrative.gathered(notes, extraction.extract_all(notes))).collect()}
    assert r[0].narrative == "Medications:\n• metformin 500 mg PO BID\n\nLaboratory Results:\n• WBC: 17.5 x10E3/uL (H)\n\nVital Signs:\nBP 120/80\n\nLab Trends:\nNo significant lab trends" and r[1].narrative == "" and r.keys() == {0, 1}


# the master timeline


@pytest.mark.parametrize(
    "name,want", [("1-2-2024.txt", "2024-01-02"), ("13/05/2024 2024-03-04", "2024-03-04"), ("2024/3/4", "2024-03-04"), ("Jan 5, 2024", "2024-01-05"), ("02/30/2024", "2024-03-01"), ("99/99/2024", None), ("", None)]
)
def test_written_dates(spark, name, want):
    got = spark.createDataFrame([(name,)], "n string").select(master.written_date(F.col("n")).cast("string").alias("d")).first().d
    assert got == want


def test_master_timeline(spark, tmp_path):
    long = "\n".join(f"line {k}" for k in range(60))
    rows = [(1, "lab 1-1-2024", "Lab report\nWBC 5 K/uL"), (2, "lab 1-2-2024", "Lab report again with more words\nWBC 6 K/uL"), (3, "copy 1-3-2024", "Lab report\nWBC 5 K/uL"), (4, "x 1-4-2024", long), (5, "none", None), (6, "none", ""), (7, "none", "words")]
    files_ = spark.createDataFrame(rows, "doc_id bigint, filename string, text string")
    docs, found, sections = master.timeline(files_, DAY)
    assert [(r.doc_id, r.document_number) for r in docs.orderBy("document_number").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4), (7, 5)]
    d = {r.document_number: r for r in found.collect()}
    assert (d[3].other_number, d[3].difference, d[3].similarity) == (1, "exact", 1.0)
    whole = "\n".join(r.markdown for r in sections.orderBy("section", "document_number").collect())
    assert "- **Total Documents**: 5 (4 unique, 1 duplicates)" in whole and "### [DUPLICATE] 01/03/2024 | copy 1-3-2024\n⚠️ This document is a exact of document #1 (100.0% similar)." in whole
    assert "#### Trends vs Previous\n- **WBC**: 5 → 6 (↑ 20.0%)" in whole and "10 additional lines omitted" in whole and "### 📄 06/01/2025 | none" in whole and "| WBC | 5 K/uL | 4-11 | ✅ Normal |" in whole
    assert master.conflicts(found).where("document_number = 3").first().message == "exact (100.0% similar)"
    master.write(sections, str(tmp_path / "t"))
    parts = sorted((tmp_path / "t").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == whole + "\n"
    back = master.documents(files_, DAY, newest_first=True)
    assert [r.doc_id for r in back.orderBy("document_number").collect()] == [7, 4, 3, 2, 1]
    assert master.markdown(master.documents(files_.where("false"), DAY)).count() == 0


def test_first_resemblance_counts(spark):
    rows = [(n, f"2024-01-{d:02d}", h, s, t) for n, d, h, s, t in [(1, 1, "a", 0, "x"), (2, 2, "b", 0b111, "x"), (3, 3, "b", 0b111, "x"), (4, 20, "c", 0b1110, "x"), (5, 21, "a", 0, "y"), (6, 22, "d", 1, "z")]]
    docs = spark.createDataFrame(rows, "document_number bigint, date string, content_hash string, simhash bigint, document_type string").withColumn("date", F.col("date").cast("date"))
    got = {r.document_number: (r.other_number, r.difference) for r in master.duplicates(docs).collect()}
    assert got == {2: (1, "same-event"), 3: (1, "same-event"), 5: (1, "exact"), 6: (1, "near-duplicate")}


def test_numbering(spark):
    df = spark.createDataFrame([(x,) for x in (5, 100_000, 7, 3_000_000, 16_383, 16_384)], "v bigint")
    assert dict(master.numbered(df, "v", "n").select("v", "n").collect()) == {5: 1, 7: 2, 16_383: 3, 16_384: 4, 100_000: 5, 3_000_000: 6}


# corpora


def corpus_docs(spark):
    head, foot = "Clinic of the North\nMain Building Two\nFloor three", "Page 1 of 2\nprinted by the system today"
    rows = [f"{head}\nnote number {k} says\nsomething {k * 7}\n{foot}" for k in range(6)]
    rows += [head.upper() + "\nother text here", "", "one line"]
    return texts(spark, *rows, None)


def test_corpus_of_templates(spark):
    docs = corpus_docs(spark)
    found = corpus.build(docs)
    got = {r.content: (r.kind, r.position, r.lines, r.documents) for r in found.collect()}
    assert got == {"Clinic of the North\nMain Building Two\nFloor three": ("HEADER", "START", 3, 7), "Page 1 of 2\nprinted by the system today": ("FOOTER", "END", 2, 6)}
    deltas = corpus.strip(docs, found)
    left = {r.doc_id: r for r in deltas.collect()}
    assert [u.content for u in left[2].unique_lines] == ["note number 2 says", "something 14"] and [(x.start, x.end) for x in left[2].refs] == [(0, 2), (5, 6)] and left[2].coverage == 5 / 7
    back = dict(corpus.reconstruct(deltas, found).collect())
    want = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {k: v for k, v in back.items() if k != 6} == {k: v for k, v in want.items() if k != 6} and back[6].startswith("Clinic of the North")
    assert dict(corpus.reconstruct(corpus.strip(docs, found, lossless=True), found).collect()) == want
    t = corpus.totals(deltas, found).first()
    assert t.templates == 2 and 0 < t.ratio < 1 and [r.kind for r in corpus.top(found).collect()] == ["HEADER", "FOOTER"]
    assert corpus.build(docs.limit(2)).count() == 0 and corpus.build(docs, corpus.Config(sample=4)).count() == 2
    assert corpus.process(docs.where("false"))[2].first().ratio == 1.0


def test_templates_within_others_equal_brute_force(spark):
    import random

    r = random.Random(3)
    rows = []
    for k in range(60):
        n = r.randint(10, 40)
        at = r.randint(0, 60)
        rows.append((str(k).encode(), ("abcdefghij klmnop qrst uvwxyz " * 4)[at : at + n], r.randint(0, 1000) * 100 + k))
    df = spark.createDataFrame(rows, "key binary, plain string, place int")
    want = {k for k, p, at in rows if any(q_at < at and p in q for _, q, q_at in rows)}
    assert {bytes(x.key) for x in corpus.within(df).collect()} == want and 5 < len(want) < 60


def test_matches_without_overlaps(spark):
    df = spark.range(1).select(F.expr("transform(array(array(0, 2), array(1, 4), array(2, 3), array(5, 6), array(6, 6)), a -> struct(a[0] as start, a[1] as end))").alias("m"))
    assert [tuple(x) for x in df.select(corpus.apart(F.col("m")).alias("a")).first().a] == [(1, 4), (5, 6)]
    assert texts(spark, "hello").select(corpus.fnv1a("text").alias("h")).first().h == "a430d84680aabd0b"
    line = texts(spark, " A  1 ")
    assert line.select(corpus.normalised(F.col("text"), corpus.Config(numbers=True)).alias("n")).first().n == "a #"


# semantic deduplication


def test_embeddings_and_representatives(spark):
    docs = texts(spark, "the quick brown fox " * 60, "the quick brown fox " * 59, "", "other words entirely", None)
    for how in ("mean", "max", "first"):
        v = {r.vec_id: np.array(r.embedding) for r in semantic.embed(docs, how=how).collect()}
        assert v.keys() == {0, 1, 2, 3} and not v[2].any()
        chunks = [semantic.hashed_words(c) for c in docs.where("doc_id = 0").select(F.explode(text.chunks(F.col("text"), 512, 50)).alias("c")).toPandas()["c"]]
        assert np.allclose(v[0], {"mean": np.mean(chunks, 0), "max": np.max(chunks, 0), "first": chunks[0]}[how])
    found, members, stats = semantic.deduplicate(docs.where("doc_id <> 2 and text is not null"), semantic.embed(docs.where("doc_id <> 2")))
    assert {(r.cluster_id, r.kind, r.members, r.representative) for r in found.collect()} == {("cluster_0", "DUPLICATE_GROUP", 2, 0), ("cluster_1", "SINGLETON", 1, 3)}
    assert tuple(stats.first())[:3] == (3, 2, 1)


def test_cluster_similarity_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.normal(size=8)
    vectors = [(i, (base + 0.3 * r.normal(size=8)).tolist()) for i in range(25)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    members = df.select("vec_id", F.lit(0).cast("long").alias("cluster"))
    v = np.array([x for _, x in vectors])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims = (v @ v.T)[np.triu_indices(25, 1)]
    monkeypatch.setattr(semantic, "MEMBERS", 7)
    got = semantic.internal(df, members).first()
    assert (got.members, round(got.average, 9), round(got.least, 9)) == (25, round(sims.mean(), 9), round(sims.min(), 9))


def test_cosine_pairs_do_not_change_with_blocks(spark, monkeypatch):
    from docloom.operators import similarity

    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(90)], "vec_id bigint, embedding array<double>")
    want = {(x.a, x.b): round(x.similarity, 9) for x in similarity.cosine_pairs(df, 0.4).collect()}
    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(similarity, "TILE", 3)
    assert {(x.a, x.b): round(x.similarity, 9) for x in similarity.cosine_pairs(df, 0.4).collect()} == want and len(want) > 100


# pages and sinks


def test_pages_to_documents(spark):
    word = lambda s, x, y: (float(x), float(y), 10.0 * len(s), s)
    items = [[word("Header", 0, 700), word("body", 0, 600), word(str(k) * 20, 60, 601), word("more text that is long enough here", 0, 500), word("Footer", 0, 10)] for k in range(5)]
    boxed = [("good", 95.0, (0.0, 0.0, 10.0, 10.0))] * 12
    rows = [(1, k + 1, items[k], None, None) for k in range(5)] + [(2, 1, [], boxed, "good " * 12), (2, 2, [], None, None)]
    df = spark.createDataFrame(rows, f"doc_id bigint, page_no int, items {pages.PLACED}, words {pages.BOXED}, ocr_text string")
    assert pages.lines_of([dict(zip(("x", "y", "width", "str"), i, strict=True)) for i in items[0]]) == "Header\nbody 00000000000000000000\nmore text that is long enough here\nFooter"
    got = {r.doc_id: r for r in pages.documents(df).collect()}
    assert got[1].text.count("--- Page Break ---") == 4 and "Header" not in got[1].text and "Footer" not in got[1].text and (got[1].pages, got[1].ocr_pages, got[1].needs_review, got[1].score) == (5, 0, False, None)
    assert got[2].text == "[OCR_RECOVERED_PAGE_1]\n" + "good " * 12 + pages.BREAK + "[OCR_UNAVAILABLE_PAGE_2]\n" and got[2].ocr_pages == 1 and got[2].level == "HIGH" and not got[2].needs_review
    assert pages.recognised(df.select("doc_id", "page_no", F.lit(b"x").alias("content")), None).where("words is null").count() == 7
    read = pages.recognised(df.select("doc_id", "page_no", F.lit(b"x").alias("content")), lambda c: [{"text": "a", "confidence": 1.0, "bbox": {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}}])
    assert {r.ocr_text for r in read.collect()} == {"a"}
    box = spark.createDataFrame([(b"x", (1.0, 2.0))], "content binary, box struct<x:double,y:double>")
    assert pages.repaired(box, None).first().repaired is None and pages.repaired(box, lambda c, b: f"{b['x']}").first().repaired == "1.0"


def test_quality_of_words(spark):
    rows = [(1, k, "word", 95.0) for k in range(12)] + [(2, 0, "|||", 20.0), (2, 1, "[OCR_RECOVERED x", 30.0)]
    got = {r.doc_id: r for r in quality.word_quality(spark.createDataFrame(rows, "doc_id int, word_idx int, text string, confidence double")).collect()}
    assert (got[1].level, got[1].flags) == ("HIGH", []) and got[2].level == "LOW" and set(got[2].flags) >= {"LOW_CONFIDENCE", "SPARSE_TEXT", "OCR_RECOVERY_MARKER", "NEEDS_MANUAL_REVIEW"}


def test_files_of_all_kinds(spark, tmp_path):
    xml = (
        '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>'
        '<w:p><w:r><w:t>a </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>b &amp; c</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    )
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", xml)
    for name, data in {"a.docx": held.getvalue(), "b.txt": "é".encode(), "c.pdf": b"%PDF", "d.bin": b"x", "e.docx": b"broken", "f.csv": b"1,2"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.filename: (r.text, r.error) for r in pages.parsed(files.read_texts(spark, str(tmp_path))).collect()}
    assert got["a.docx"] == ("# Title\n\na **b & c**\n\n| x | y |\n|---|---|", None) and got["b.txt"] == ("é", None) and got["f.csv"] == ("1,2", None)
    assert got["d.bin"] == (None, "Unsupported file type: ") and got["e.docx"][1].startswith("BadZipFile") and "recognised" in got["c.pdf"][1]


def test_archives_and_metadata(spark):
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("c", None)], "name string, markdown string")
    held = {}
    for r in sinks.zipped(docs, "name", 2).collect():
        with zipfile.ZipFile(io.BytesIO(r.content)) as z:
            held |= {(r.archive, n): z.read(n).decode() for n in z.namelist()}
    assert sorted(held.values()) == ["x", "y", "z"] and all(n.startswith("Scrubbed_") for _, n in held)
    y = spark.range(1).select(sinks.yaml_metadata(F.lit(20), F.lit(5), F.lit(10.0), F.lit(2.5), "2025-06-01").alias("y")).first().y
    assert "    ratio: 25.0%\n    eventsTotal: 20\n    eventsIncluded: 5\n    eventsRemoved: 15" in y
    ids = [r.i for r in spark.range(3).select(sinks.new_id().alias("i")).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 36 for i in ids)


def test_log_shows_no_content():
    entry = log.Log().line("info", "read", file="a.txt", rawText="secret", nested={"content": "secret", "n": 1}, long="x" * 200, many=["a\nb", "c"])
    assert "secret" not in entry and "xxx" not in entry and '"n": 1' in entry and '"c"' in entry
    quiet = log.Log(production=True)
    assert quiet.line("info", "x") is None and quiet.line("error", "x") is not None


def test_tries():
    waits, runs = [], []

    def fail(recoverable):
        runs.append(1)
        raise errors.Failure("FileSystemError", "no", recoverable, path="x")

    got, e = errors.tried(lambda: fail(True), 3, 1.0, waits.append)
    assert got is None and e.record()["impact"] == "high" and e.record()["details"] == {"path": "x"} and waits == [1.0, 2.0] and len(runs) == 3
    assert errors.tried(lambda: fail(False), 3, 1.0, waits.append)[0] is None and len(runs) == 4
    assert errors.tried(lambda: 5) == (5, None)
    with pytest.raises(ValueError):
        errors.tried(lambda: 5, 0)


def test_compression_plans(spark):
    docs = corpus_docs(spark)
    cfg = compression.Config(ocr=False, template=True, dedup=False)
    r = {x.doc_id: x for x in compression.run(docs, cfg).collect()}
    assert r.keys() == set(range(9)) and r[8].final_chars == 8 and r[7].final_chars == 0
    s = {x.doc_id: x for x in compression.single(docs).collect()}
    assert s[7].warnings == ["OCR quality too low: 0%"] and s[7].final_chars == 0
    assert compression.Config(dedup=False).stages() == ["OCR_QUALITY", "TEMPLATE_DETECTION", "STRUCTURED_EXTRACTION", "NARRATIVE_GENERATION"]
    assert compression.stage("SEMANTIC_DEDUP", docs).first().documents_in == 9
    with pytest.raises(ValueError):
        compression.stage("other", docs)
    t = compression.totals(compression.run(docs.where("false"))).first()
    assert (t.documents, t.ratio) == (0, 0.0)
    assert spark.range(1).select(compression.shown(F.lit(0.256)).alias("s")).first().s == "25.6%"


def test_narratives_equal_sql_with_many_parts(spark, tmp_path):
    """Keys of parts beyond a million do not change the order of an order's lines."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("create table lineitem as select * replace (l_partkey + l_linenumber % 3 * 1200000 as l_partkey) from '/root/testdata/sf0.001/lineitem.parquet'")
    con.sql(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    for name in ("narratives", "narratives_brief"):
        got = catalog.QUERIES[name](spark, str(tmp_path)).select("doc_id", "narrative", "output_chars").collect()
        want = con.sql(f"select doc_id, narrative, output_chars from ({catalog.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got)) == sorted(want) and len(want) > 1000


@pytest.mark.parametrize("name", ["record_labs", "record_medications", "record_diagnoses", "record_active_diagnoses"])
def test_records_are_computed_once(spark, name):
    """No filter on a record's lists is computed from the charts again, and the charts are dealt out over the cores."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]
    assert "RepartitionByExpression" in plan


def test_same_event_is_found_in_blocks():
    """The first number within nine bits equals that by brute force, over more prints than a block holds."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 32, 3000)
    prints[100:200] = prints[:100]
    number = rng.permutation(3000)
    day = datetime.date(2024, 1, 1)
    table = pa.table({
        "document_type": ["x"] * 6000, "date": [day] * 6000, "simhash": np.concatenate([prints, prints]), "first": np.concatenate([number, number]), "own": [True] * 3000 + [False] * 3000,
    })
    got = master.same_event()(table).column("event_no").to_numpy()
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).astype(np.uint32)) <= 9
    assert (got == np.where(near, number, 9999).min(axis=1)).all()
