"""Typed values, subjects and comparisons against a sequential brute force, and lines on documents and tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from doclens.functions import values as V
from doclens.operators import comparison as C
from doclens.operators import retrieval as R
from doclens.operators import structure as S


def brute_values(text):
    """The rule, match by match."""
    taboo = {float(n) for p in (V.NUMBERED_STANDARD, V.STANDARD_CONTEXT) for m in re.finditer(p, text) for n in re.findall(r"\d+", m[0])}
    taboo |= {float(y) for y in re.findall(V.YEAR, text)}
    out = []
    for kind, pattern in V.VALUE_PATTERNS.items():
        low, high = V.RANGES.get(kind, (None, None))
        for m in re.finditer(pattern, text, re.I):
            value = float(m[1])
            near = text[max(0, m.start() - 25) : m.end() + 10].lower()
            if value in taboo or (value == int(value) and 1000 <= value <= 99999 and any(p in near for p in V.PREFIXES)):
                continue
            if (low is None or value >= low) and (high is None or value <= high):
                context = text[max(0, m.start() - 60) : m.end() + 20].lower()
                named = next((x[0].strip().lower() for p in V.SUBJECTS.get(kind, ()) if (x := re.search(p, context, re.I))), None)
                word = next((w for w in re.findall(r"\b([a-z]{4,})\b", context) if w in V.TECHNICAL_WORDS), None)
                out.append((kind, value, m[0], m.start(), named or (f"{word} {kind.replace('_', ' ')}" if word else kind)))
    return out


TEXTS = [
    "Cable size shall be 2.5 mm2 to EN 61386-1-21 of 2015, length of run 40 m at 230 V.",
    "The breaker rating is 16 A; fault current 10 kA, response time 20 ms, 5000 A not.",
    "Temperature -5 °C to 40.5 °C, rise 600 C. Voltage drop below 3 % of 400V",
    "",
    "no numbers at all",
    "BS 7671 asks for 1500 W near bs 12 and 1500 W far away from any of those prefixes that count here",
    "12 kWh, 3 m³/h, 0.25 W/m2K, 45 dBA, 500 lux, 12 Nm, 1450 rpm, 2 bar, 30 kg, 5 l/s, 100 ppm, 3 COP",
]


def test_values_equal_brute_force(spark):
    rng = random.Random(3)
    parts = ["cable length", "conductor size", "EN 50123-1", "IEC 60364", "1999", "2.5 mm2", "40 m", "16 A", "230 V", "°C", "10", "0.5 s", "depth", "trench", ";", "bs 12", "5000", "W", "kW", "max current", "é"]
    texts = TEXTS + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", V.typed("text").alias("v"))
    for r in df.collect():
        assert [(v["type"], v["value"], v["original"], v["start"], v["subject"]) for v in r["v"]] == brute_values(texts[r["i"]]), texts[r["i"]]


@pytest.mark.parametrize("a,b,related", [("cable length", "cable length", True), ("length", "cable length", True), ("cable size", "conductor area", True), ("fuse rating", "mcb current", True), ("voltage drop", "lighting voltage", True), ("trench depth", "motor power", False), ("current", "voltage", False), ("maximum run", "min distance", True)])
def test_related_subjects(spark, a, b, related):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(V.subjects_related(F.col("a"), F.col("b"))).first()[0] is related


CHUNKS = [
    ("s1", "A", 0, "The cable length in the trench shall be 40 m for the motor panel"),
    ("s2", "A", 1, "The cable length in the duct shall be 50 m for the motor board"),
    ("s3", "A", 2, "Power cables shall not be laid in the trench without sand"),
    ("r1", "B", 0, "The cable length in the trench shall be 60 m for the motor panel"),
    ("r2", "B", 1, "Power cables shall be laid in the trench with sand"),
    ("r3", "B", 2, "Nothing of that kind"),
]


def corpus(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, file_name string, pos long, text string")
    return chunks, spark.createDataFrame([("A", "B")], "source_doc string, reference_doc string")


def test_comparison_of_similar_chunks(spark):
    chunks, pairs = corpus(spark)
    assert [(r["reference_chunk"], r["source_chunk"], r["rank"]) for r in C.similar_chunks(chunks, pairs).orderBy("reference_chunk", "rank").collect()][:2] == [("r1", "s1", 1), ("r1", "s2", 2)]
    got = {(r["type"], r["source_value"], r["reference_value"], r["status"], r["severity"]) for r in C.value_comparisons(chunks, pairs).collect()}
    assert {("length", 40.0, 60.0, "LOWER", "high"), ("length", 50.0, 60.0, "LOWER", "medium")} <= got
    best = {r["chunk_id"]: r["source_chunk"] for r in C.best_chunks(C.mandatory_requirements(chunks), chunks, pairs).collect()}
    assert best == {"r1": "s1", "r2": "s3"}
    (issue,) = [r for r in C.requirement_conflicts(chunks, pairs).collect() if r["chunk_id"] == "r1"]
    assert (issue["source_chunk"], issue["type"], issue["source_value"], issue["required_value"], issue["severity"]) == ("s1", "length", 40.0, 60.0, "high")
    assert C.value_comparisons(chunks.limit(0), pairs).count() == 0


def test_strength_conflicts_go_either_way(spark):
    rows = [(c, f, t, "prohibited" if "not" in t else "mandatory") for c, f, _, t in CHUNKS if "shall" in t]
    df = spark.createDataFrame(rows, "id string, file_name string, sentence string, strength string")
    for pair in (("A", "B"), ("B", "A")):
        pairs = spark.createDataFrame([pair], "source_doc string, reference_doc string")
        got = {frozenset((r["id1"], r["id2"])) for r in C.strength_conflicts(df, pairs).collect()}
        words = {i: set(t.lower().split()) for i, _, t, _ in rows}
        want = {frozenset((a[0], b[0])) for a in rows for b in rows if a[1] != b[1] and a[3] != b[3] and len(words[a[0]] & words[b[0]]) / max(len(words[a[0]]), len(words[b[0]])) > 0.3}
        assert got == want and frozenset(("s3", "r2")) in got


def test_lines_on_documents_tables_and_answers(spark):
    one = lambda *c: spark.range(1).select(*c).first()[0]
    text = lambda t: F.lit(t)
    assert one(S.table_context(text("Table 3: Loads\n| a | b |\n|---|---|\n| 1 | 2 |"))) == "Contains Table 3: Loads"
    assert one(S.table_context(text("x\n| a | b | c | d | e | f |\n|---|---|\n"))) == "Contains table with columns: a, b, c, d, e"
    assert one(S.table_context(text("a | b"))) is None and one(S.table_context(text("x |--| y"))) == "Contains tabular data"
    assert one(S.document_summary(text("n"), text(""), text("EN 1"), text("a, b"))) == "Technical standard EN 1 (n) covering a, b"
    assert one(S.document_summary(text("n"), text("d"), text("EN 1"), text(""))) == "Document 'n': d"
    assert one(S.document_summary(text("n"), F.lit(None).cast("string"), text(""), text(""))) == "Document 'n'"
    assert [one(R.informative(text(t))) for t in ("short", "The text is not available in this place", "A long and useful answer to it")] == [False, False, True]
    assert one(R.informative(F.lit(None).cast("string"))) is False


def drawn_corpus(spark, seed=11):
    """Documents of 1 to 6 chunks of technical words, one of them empty and one null, and pairs of them."""
    rng = random.Random(seed)
    words = ["cable", "Cable", "trench,", "sand", "motor", "panel", "depth", "voltage", "shall", "must", "shall not", "the", "of", "in", "40 m", "16 A", "230 V", "2.5 mm2", "20 ms", "A;", "x. B", "laid"]
    rows = [(f"d{d}-{c}", f"d{d}", c, " ".join(rng.choice(words) for _ in range(rng.randint(6, 22)))) for d in range(14) for c in range(rng.randint(1, 6))]
    rows += [("e-0", "d0", 90, ""), ("e-1", "d1", 91, None)]
    pairs = [(f"d{d}", f"d{d + 1}") for d in range(13)] + [("d5", "d2"), ("d7", "d9"), ("none", "d1"), ("d1", "none")]
    return rows, pairs, spark.createDataFrame(rows, "chunk_id string, file_name string, pos long, text string"), spark.createDataFrame(pairs, "source_doc string, reference_doc string")


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similar_chunks_equal_brute_force_for_small_and_large_documents(spark, monkeypatch):
    rows, pairs, chunks, met = drawn_corpus(spark)
    words = {c: set((t or "").lower().split()) for c, _, _, t in rows}
    context = {c: {w for w in (re.sub("[^a-z]", "", x) for x in ws) if w in V.CONTEXT_WORDS} for c, ws in words.items()}
    want = []
    for s, r in pairs:
        for c, f, pos, _ in rows:
            if f == r:
                found = sorted((-len(context[c] & context[o]), -len(words[c] & words[o]), p, o) for o, g, p, _ in rows if g == s and len(context[c] & context[o]) >= 2 and len(words[c] & words[o]) >= 5)
                want += [(s, r, c, pos, x[3], n + 1) for n, x in enumerate(found[:2])]
    small = C.similar_chunks(chunks, met)
    # no row for each pair of words of a chunk
    assert rows_of(small) == sorted(map(repr, want)) and len(want) > 5 and "explode(" not in plan_of(small)
    for most in (0, 3):
        monkeypatch.setattr(C, "LARGE", most)
        assert rows_of(C.similar_chunks(chunks, met)) == sorted(map(repr, want))


@pytest.mark.parametrize("query", ["value_comparisons", "conflict_analysis", "requirement_conflicts", "best", "strength"])
def test_comparisons_are_equal_for_small_and_large_documents(spark, monkeypatch, query):
    _, _, chunks, pairs = drawn_corpus(spark)
    sentences = chunks.select(F.concat_ws("/", "chunk_id", "text").alias("id"), "file_name", F.col("text").alias("sentence"), F.when(F.contains("text", F.lit("shall not")), "prohibited").when(F.col("text").rlike("shall|must"), "mandatory").alias("strength"))
    run = {"best": lambda: C.best_chunks(C.mandatory_requirements(chunks), chunks, pairs), "strength": lambda: C.strength_conflicts(sentences, pairs)}.get(query) or (lambda: getattr(C, query)(chunks, pairs))
    small = run()
    want = rows_of(small)
    # rows of small documents are compared where they lie: words aren't sent one by one
    assert want and (query not in ("best", "strength") or "explode(array_" not in plan_of(small))
    for most in (0, 3):
        monkeypatch.setattr(C, "LARGE", most)
        assert rows_of(run()) == want


def test_a_text_is_read_once_for_its_values(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", t) for i, t in enumerate([*TEXTS, *TEXTS, None])], "chunk_id string, file_name string, text string")
    values = C.chunk_values(chunks)
    got = {}
    for r in sorted(values.collect(), key=lambda r: r["i"]):
        got.setdefault(r["chunk_id"], []).append((r["type"], r["value"], r["original"], r["start"], r["subject"]))
    assert got == {f"c{i}": found for i, t in enumerate([*TEXTS, *TEXTS]) if (found := brute_values(t))}
    assert "Aggregate [text" in plan_of(values)


def test_values_come_from_texts_that_met_and_need_no_join(spark):
    _, _, chunks, pairs = drawn_corpus(spark)
    for df in (C.value_comparisons(chunks, pairs), C.requirement_conflicts(chunks, pairs)):
        # one brings the reference's rows to the pairs, one the source's
        assert plan_of(df).count("Join Inner") == 2


UNITS = "°C C V Volt Volts A Amps kW MW W VA kVA MVA Ω ohm ohms Ω/km mm² mm2 Hz bar psi kPa MPa Pa l/s L/s m³/h m3/h l/min L/min gpm cfm rpm RPM rev/min Nm N.m kNm mm cm inch in \" thick kg ton tonne lb lbs m³ m3 litre liter L gallon BTU BTU/h tons TR W/m²K W/m2K m²K/W m2K/W dB dBA lux lx ppm μg/m³ mg/m³ kWh MWh GJ kgCO2 tCO2 kgCO2e m³/day L/day gallon/day COP EER SEER % m² m2 sq.m sqm ft² sq.ft m km ms s sec min hours hrs".split()


def test_every_unit_is_found_behind_any_number(spark):
    rng = random.Random(8)
    texts = [f"{n}{gap}{u}{end}" for u in UNITS for n, gap, end in (("7", "", ""), ("2.5", " ", " x"), ("1.2.25", "  ", ".5 mm2"), ("3", "", "2 m2.5 m2 3 m"))]
    texts += ["".join(rng.choice([*UNITS, "3", "2", ".", " ", "1.5 ", "mm2", "m2", "\x01", "\x02"]) for _ in range(rng.randint(2, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", V.typed("text").alias("v"))
    for r in df.collect():
        plain = texts[r["i"]].translate({1: " ", 2: " "})
        assert [(v["type"], v["value"], v["original"], v["start"]) for v in r["v"]] == [v[:4] for v in brute_values(plain)], texts[r["i"]]
