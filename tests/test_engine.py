import collections
import io
import os
import random
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tagveil.functions import text as T
from tagveil.operators import detect, matching, redact, restore
from tagveil.operators.mint import mint
from tagveil.operators.segments import redistribute
from tagveil.plans.api import Engine
from tagveil.sources import docx, providers, stores

ENTITIES = [("Orbit Mills Ltd", "[[MILL_1]]"), ("Orbit Lending", "[[LOANS_1]]"), ("Quarry Works", "[[WORKS_2]]"), ("Quarry", "[[YARD_2]]"), ("Harbor Trust", "[[LENDER_9]]")]


def entries(spark, pairs=ENTITIES):
    return spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(pairs)], "term string, tag string, ord long")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def redacted(spark, pairs, *texts):
    return {r.doc_id: r for r in redact.redact(docs(spark, *texts), entries(spark, pairs)).collect()}


#: Words that names and texts are made of: some within others, some of other scripts.
PIECES = ["lark", "larkin", "ridge", "Ridge-Way", "o'dell", "7th", "b2b", "münch", "Ünal", "дом", "山", "x_y", "A.", "$9"]


def made_terms(pick, n):
    """Distinct terms of one to three words with a tag each, some shared."""
    terms = {}
    while len(terms) < n:
        term = " ".join(pick.choice(PIECES) for _ in range(pick.choice([1, 1, 2, 2, 3])))
        terms.setdefault(term.lower(), (term, f"[[N_{pick.randrange(n)}]]"))
    return list(terms.values())


def made_text(pick, n):
    """Words in any case with any gaps, so that terms stand whole, within others, over line ends and cut off."""
    words = (pick.choice([w, w, w.upper(), w.title(), w + "s", w + "'s", "é" + w]) for w in (pick.choice(PIECES) for _ in range(n)))
    return "".join(w + pick.choice([" ", " ", " ", "  ", "\n", "\t", ", ", "-", "", "\u00a0"]) for w in words)


def plain_matches(text, pairs):
    """(start, end, tag) by a left-to-right sweep over every term's own matches."""
    found = []
    for order, (term, tag) in enumerate(pairs):
        rx = re.compile(r"(?<![0-9A-Za-z])" + r"\s+".join(map(re.escape, term.split())) + r"(?![0-9A-Za-z])", re.I)
        found += [(m.start(), m.start() - m.end(), order, m.end(), tag) for m in rx.finditer(text)]
    taken, end = [], 0
    for start, _, _, stop, tag in sorted(found):
        if start >= end:
            taken.append((start, stop, tag))
            end = stop
    return taken


def plain_redaction(text, pairs):
    out, at = [], 0
    for start, stop, tag in plain_matches(text, pairs):
        out += [text[at:start], tag]
        at = stop
    return "".join([*out, text[at:]])


def plain_leaks(text, pairs):
    return sorted(t for t, _ in pairs if re.search(r"(?<![0-9A-Za-z])" + r"\s+".join(map(re.escape, t.split())) + r"(?![0-9A-Za-z])", text, re.I))


def test_redaction_by_a_plain_sweep(spark):
    pick = random.Random(11)
    pairs = made_terms(pick, 25)
    texts = [made_text(pick, pick.randrange(40)) for _ in range(150)] + ["", None]
    got = redacted(spark, pairs, *texts)
    for i, text in enumerate(texts):
        new = None if text is None else plain_redaction(text, pairs)
        left = plain_leaks(new or "", pairs)
        assert (got[i].ok, got[i].redacted_text, got[i].leaked) == (not left, None if left else new, left), text
    assert 0 < sum(r.ok for r in got.values()) < len(texts) and any(r.n_matches > 3 for r in got.values())


def test_sweep_order_and_leaks(spark):
    assert redacted(spark, [("A B", "[[T0]]"), ("B C D", "[[T1]]")], "A B C D")[0].redacted_text == "[[T0]] C D"
    skipped = redacted(spark, [("x a", "[[T0]]"), ("a a", "[[T1]]")], "x a a a")[0]
    assert not skipped.ok and skipped.redacted_text is None and skipped.leaked == ["a a"]
    inside = redacted(spark, [("EMAIL", "[[EMAIL_1]]")], "an EMAIL here")[0]
    assert not inside.ok
    dollars = redacted(spark, [("ключ", r"[[A]]"), ("$5", "[[PRICE]]"), ("--", "[[DASH]]")], "ключ costs $5 or -- $1")[0]
    assert dollars.redacted_text == "[[A]] costs [[PRICE]] or [[DASH]] $1"


def test_entries_are_cleaned_and_share_tags(spark):
    rows = entries(spark, [(" Ann ", "client one"), ("ann", "[[B]]"), ("", "[[C]]"), ("Bob", "!!"), ("Eve", "client_one")])
    clean = [(r.term, r.tag) for r in redact.clean_entries(rows).orderBy("ord").collect()]
    assert clean == [("Ann", "[[CLIENT_ONE]]"), ("Eve", "[[CLIENT_ONE]]")]
    assert [(r.tag, r.value, r.ord) for r in redact.tag_values(redact.clean_entries(rows)).collect()] == [("[[CLIENT_ONE]]", "Eve", 0)]


@pytest.mark.parametrize(
    ("text", "type_", "term"),
    [
        ("Account Number: 4471-88231", "account", "4471-88231"), ("Invoice #: INV-2024-0091", "doc_number", "INV-2024-0091"),
        ("Statement No. 55871234", "doc_number", "55871234"), ("Customer ID: C-90887", "doc_number", "C-90887"),
        ("San Francisco, CA 90210", "zip", "90210"), ("San Francisco, CA 90210", "place", "CA"), ("Austin, TX 78701-1234", "zip", "78701-1234"),
        ("The total was 4471 units.", "account", None), ("The total was 4471 units.", "doc_number", None), ("account notes2024x", "account", "tes2024x"),
        ("pay 4111111111111111 now", "credit_card", "4111111111111111 "), ("4111111111111111 123", "credit_card", None), ("a 021000021 b", "routing", "021000021"),
        ("a 021000022 b", "routing", None), ("mail jané.o@x-y.example.com.", "email", "jané.o@x-y.example.com"), ("call (555) 123-4567!", "phone", "(555) 123-4567"),
        ("see https://a.b/c?d=e).", "url", "https://a.b/c?d=e"), ("DE89370400440532013000", "iban", "DE89370400440532013000"),
    ],
)
def test_patterns(spark, text, type_, term):
    found = [r.t for r in detect.pattern_spans(docs(spark, text)).where(F.col("type") == type_).collect()]
    assert (term in found) if term else not found


def test_spans_equal_finditer_on_the_corpus(spark):
    import re

    from tagveil.functions.patterns import catalogue

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = docs(spark, "TX 78701-1234 a@b.co,c@d.org (555) 123-4567 5551234567 x", "order no. A12 order B13; acct 99-1 invoice #: Ä12", "\x01a@b.co\x02 c@d.org \x01, order A12", "$5 $1 a@b.co $2").withColumn("doc_id", F.col("doc_id") + 10_000)
    texts = {r.doc_id: r.text for r in table.union(extra).collect()}
    patterns = catalogue(True)
    got = {(r.doc_id, r.pat_ord, r.s, r.e, r.t) for r in detect.pattern_spans(table.union(extra), tuple(p.__class__(**{**p.__dict__, "valid": None}) for p in patterns)).collect()}
    want = set()
    for i, p in enumerate(patterns):
        rx = re.compile(p.before + "(" + p.value + ")" + p.after, re.I if p.ignore_case else 0)
        want |= {(d, i, m.start(1), m.end(1), m[1]) for d, t in texts.items() for m in rx.finditer(t)}
    assert got == want and len(want) > 60


def test_zip_is_found_twice_and_counted(spark):
    r = detect.detect_patterns(docs(spark, "TX 78701-1234"), spark.createDataFrame([], "tag string")).where("type = 'zip'").collect()
    assert [(x.term, x.n, x.tag, x.contexts) for x in r] == [("78701-1234", 2, "[[ZIP_1]]", ["TX 78701-1234"] * 2)]


def test_minting_skips_taken_numbers(spark):
    new = spark.createDataFrame([(i, "email") for i in range(4)], "s int, prefix string")
    taken = spark.createDataFrame([(t,) for t in ("[[EMAIL_1]]", "[[EMAIL_2]]", "[[EMAIL_4]]", "[[EMAIL_04]]", "[[PHONE_3]]", "x")], "tag string")
    assert [r.tag for r in mint(new, taken, [], ["s"]).orderBy("s").collect()] == ["[[EMAIL_3]]", "[[EMAIL_5]]", "[[EMAIL_6]]", "[[EMAIL_7]]"]


def test_analysis_merges_and_ranks(spark):
    text = "Old old@z.com, new@w.com and NEW@W.COM and new@w.com; jane of Acme, Jane of Statement Date."
    dictionary = entries(spark, [("old@z.com", "[[EMAIL_1]]"), ("acme", "[[CO]]")])

    def model(frame):
        at = [(text.index("jane"), 4, "PERSON"), (text.index("Jane"), 5, "PERSON"), (text.index("Acme"), 4, "ORG"), (text.index("Statement"), 14, "ORG")]
        return frame.crossJoin(spark.createDataFrame([(s, s + n, k) for s, n, k in at], "s int, e int, label string")).select("doc_id", "s", "e", "label")

    rows = detect.analyze(docs(spark, text), dictionary, names=model).orderBy("pos").collect()
    assert [(r.term, r.source, r.tag, r.n, r.checked) for r in rows] == [
        ("Acme", "dictionary", "[[CO]]", 1, True), ("old@z.com", "dictionary", "[[EMAIL_1]]", 1, True),
        ("new@w.com", "pattern", "[[EMAIL_3]]", 2, True), ("jane", "ner", "[[PERSON_1]]", 2, False),
    ]
    assert rows[2].contexts[0].startswith("Old old@z.com") and rows[2].contexts[0].endswith("…")


def test_restore(spark):
    mapping = spark.createDataFrame([("[[MILL_1]]", r"Orbit $1 \ Ltd", 0), ("[[B_2]]", "Bob", 1)], "tag string, value string, ord long")
    texts = ["Note to **[[MILL_1]]**, [[ MILL_1 ]] or [[Mill 1]].", "Ask [[MILL_1]] or [[NOBODY_3]].", "****[[B_2]]****", "[[MILL-1]]", None, ""]
    got = {r.doc_id: r for r in restore.restore(docs(spark, *texts), mapping).collect()}
    assert got[0].mangled == {"[[MILL_1]]": 3} and "[[" not in got[0].restored_text
    assert (got[1].restored_text, got[1].leftover, got[1].total) == (r"Ask Orbit $1 \ Ltd or [[NOBODY_3]].", ["[[NOBODY_3]]"], 1)
    assert got[2].restored_text == "*Bob*" and got[3].leftover == ["[[MILL-1]]"] and got[5].restored_text == ""
    text = "Orbit Mills Ltd owes Quarry Works, and Harbor Trust lends to Quarry."
    hidden = redact.redact(docs(spark, text), entries(spark)).select("doc_id", F.col("redacted_text").alias("text"))
    back = restore.restore(hidden, spark.createDataFrame([(g, t, i) for i, (t, g) in enumerate(ENTITIES)], mapping.schema)).first()
    assert (back.restored_text, back.leftover) == (text, [])


def cut(pick, text):
    """The text in runs, some of them empty."""
    places = sorted(pick.randrange(len(text) + 1) for _ in range(pick.randrange(6)))
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)], strict=True)]


def test_matches_over_runs(spark):
    pick = random.Random(12)
    pairs = made_terms(pick, 12)
    cuts = [cut(pick, made_text(pick, 12)) for _ in range(60)]
    runs = spark.createDataFrame([(d, i, t) for d, c in enumerate(cuts) for i, t in enumerate(c)], "doc_id long, seg_idx int, text string")
    rows = {(r.doc_id, r.seg_idx): r for r in redistribute(runs, matching.term_rules(entries(spark, pairs))).collect()}
    for d, c in enumerate(cuts):
        text, new = "".join(c), [rows[d, i].new_text for i in range(len(c))]
        assert "".join(new) == plain_redaction(text, pairs)
        # what no match touches stays in its run
        kept = [True] * len(text)
        for start, stop, _ in plain_matches(text, pairs):
            kept[start:stop] = [False] * (stop - start)
        at = 0
        for i, t in enumerate(c):
            assert len("".join(x for x, k in zip(t, kept[at : at + len(t)], strict=True) if k)) <= len(new[i])
            if all(kept[at : at + len(t)]) and t:
                assert t in new[i]
            assert rows[d, i].preserve == (new[i] != new[i].strip())
            at += len(t)


def word_file(parts):
    """A file of (member, paragraphs of runs); a member of properties has (field, value) pairs."""
    w, out = docx._W[1:-1], io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, paragraphs in parts:
            if name.startswith("docProps"):
                z.writestr(name, "<p>" + "".join(f"<{k}>{escape(v)}</{k}>" for k, v in paragraphs) + "</p>")
            else:
                z.writestr(name, f'<w:d xmlns:w="{w}">' + "".join("<w:p>" + "".join(f"<w:r><w:t>{escape(t)}</w:t></w:r>" for t in p) + "</w:p>" for p in paragraphs) + "</w:d>")
        z.writestr("media/raw.bin", bytes(range(256)))
    return out.getvalue()


def test_word_files_by_a_plain_sweep(spark, tmp_path):
    pick = random.Random(13)
    pairs = made_terms(pick, 8)
    written = []
    for _ in range(40):
        parts = [("word/document.xml", [cut(pick, made_text(pick, pick.randrange(8))) for _ in range(4)]), ("word/footnotes.xml", [cut(pick, made_text(pick, 3))])]
        parts += [("docProps/app.xml", [("Manager", made_text(pick, 2) or "none"), ("Template", "lark")])] if pick.random() < 0.5 else []
        written.append(parts)
    rows = [(pick.choice([None, 1, 2]), word_file(parts), parts) for parts in written]
    rows += rows[:5] + rows[:2]  # repeated rows
    got = docx.redacted(spark.createDataFrame([r[:2] for r in rows], "doc_id long, content binary"), entries(spark, pairs)).collect()
    want = []
    for doc_id, _, parts in rows:
        lines = [(name, "".join(p) if not name.startswith("docProps") else p[1]) for name, ps in parts for p in ps if not name.startswith("docProps") or (p[0] == "Manager" and p[1].strip())]
        new = "\n".join(x for x in (plain_redaction(t, pairs) for _, t in lines) if x)
        left = plain_leaks(new, pairs)
        counts = collections.Counter(name for name, t in lines for _ in plain_matches(t, pairs))
        want.append((doc_id, not left, None if left else new, left, None if left else sorted(counts.items())))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.ok, r.text, r.leaked, None if r.replaced is None else sorted(r.replaced.items()))) for r in got)
    assert 0 < sum(r.ok for r in got) < len(got)
    for r in got:
        assert r.ok == (r.content is not None)
        if r.ok:
            with zipfile.ZipFile(io.BytesIO(bytes(r.content))) as z:
                assert z.read("media/raw.bin") == bytes(range(256))
                assert "docProps/app.xml" not in z.namelist() or b"<Template>lark</Template>" in z.read("docProps/app.xml")


def test_equal_files_are_held_back_each(spark):
    """A term that two equal rows hold, and one over two paragraphs, with equal, missing and repeated ids."""
    pairs = [("Bob", "Bob"), ("Acme Corp", "[[A]]")]
    one, two = docx.plain_docx(["Bob"]), docx.plain_docx(["Acme", "Corp"])
    files = spark.createDataFrame([(1, one), (1, one), (None, one), (None, one), (2, two), (2, two), (2, one), (None, two)], "doc_id long, content binary")
    rows = docx.redacted(files, entries(spark, pairs)).collect()
    assert len(rows) == 8
    # the tag of Bob holds the term itself, so the gate takes none of those files for clean
    assert not any(r.ok for r in rows) and all(r.content is None and r.text is None for r in rows)
    assert sum(not r.ok and r.leaked == ["Acme Corp"] for r in rows) == 3
    single = docx.redacted(files.where("doc_id = 2").limit(1), entries(spark, pairs)).first()
    assert not single.ok and single.content is None


def test_files_restore_what_they_hid(spark, tmp_path):
    pick = random.Random(14)
    pairs = [(t, f"[[M_{i}]]") for i, (t, _) in enumerate(made_terms(pick, 6))]
    texts = [" and ".join(pick.choice(pairs)[0] for _ in range(4)) for _ in range(10)]
    engine = Engine(spark, f"{tmp_path}/d.json", f"{tmp_path}/m")
    files = spark.createDataFrame([(i, docx.plain_docx([t])) for i, t in enumerate(texts)], "doc_id long, content binary")
    hidden = engine.redact_files(files, entries(spark, pairs)).where("ok").select("doc_id", "content")
    mapping = spark.createDataFrame([(g, t, i) for i, (t, g) in enumerate(pairs)], "tag string, value string, ord long")
    back = {r.doc_id: r.text for r in docx.texts(engine.restore_files(hidden, mapping)).collect()}
    assert len(back) > 3 and all(texts[i] == t for i, t in back.items())


def test_engine_learns_and_restores(spark, tmp_path):
    engine = Engine(spark, f"{tmp_path}/d.json", f"{tmp_path}/m")
    engine.dictionary.add(spark.createDataFrame([("Quarry", "yard 9", None, 0), (" ", "x", None, 1)], stores.ENTRY))
    text = "Quarry called Orbit Lending. Orbit Lending sold."
    out = engine.redact(docs(spark, text), entries(spark), "job-1").first()
    assert out.ok and out.n_matches == 3
    known = {r.term: (r.tag, r.source) for r in engine.dictionary.load().collect()}
    assert known["Quarry"] == ("[[YARD_2]]", "manual") and known["Harbor Trust"] == ("[[LENDER_9]]", "redaction")
    assert [(r.tag, r.value, r.n) for r in engine.mappings.all_entries().orderBy("tag").collect()] == [("[[LOANS_1]]", "Orbit Lending", 2), ("[[YARD_2]]", "Quarry", 1)]
    assert engine.restore(docs(spark, out.redacted_text)).first().restored_text == text
    assert engine.mappings.count() == 1 and engine.mappings.forget("job-1") and not engine.mappings.forget("../x")
    assert engine.capabilities()["names"] is False


def test_dictionary_rules(spark, tmp_path):
    def frame(*rows):
        return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], stores.ENTRY)

    pick = random.Random(15)
    sides = [[(pick.choice(["Nimbus", "nimbus.", "LUMEN", "lumen", "Sol 3", "sol-3", "!", "ключ"]), f"[[{side}_{i}]]", pick.choice(["manual", None])) for i in range(12)] for side in "AB"]
    keys, places, last = [], {}, {}
    for row in sides[0] + sides[1]:
        key = re.sub(r"[^\w\s]", "", row[0].lower()).strip()
        places.setdefault(key, len(places))
        last[key] = row
    merged = stores.merge(frame(*sides[0]), frame(*sides[1]))
    keys = sorted(places, key=places.get)
    assert [(r.term, r.tag, r.source) for r in merged.orderBy("ord").collect()] == [last[k] for k in keys]
    up = stores.upsert(frame(), frame(("Company Name Inc.", "[[A]]", None), ("company Name  inc", "[[B]]", "redaction")))
    assert [(r.term, r.tag, r.source) for r in up.collect()] == [("company Name  inc", "[[B]]", "manual")]
    one = stores.Dictionary(spark, f"{tmp_path}/a/d.json")
    one.save(frame(("x", "[[X]]", None)))
    two = one.move(f"{tmp_path}/b/d.json")
    assert two.load().count() == 1 and not one.path.exists() and two.move(f"{tmp_path}/b/d.json") is two
    assert two.reset(f"{tmp_path}/a/d.json").load().count() == 1 and two.path.exists()
    assert two.remove("X.").count() == 0 and oct(two.path.stat().st_mode & 0o777) == "0o600"


def test_scalars(spark):
    def value(column, *row):
        return spark.createDataFrame([row], ", ".join(f"c{i} string" for i in range(len(row)))).select(column).first()[0]

    c = F.col("c0")
    for raw, tag in (("mill 1", "[[MILL_1]]"), ("[[SSN_1]]", "[[SSN_1]]"), ("  straße 1 ", "[[STRASSE_1]]"), ("[[]]", ""), ("--", "")):
        assert value(T.normalize_tag(c), raw) == tag
    assert value(T.norm_key(c), "Company_Name Inc.") == "company_name inc" and value(T.norm_key_ui(c), "O'Brien_ & Co.") == "obrien co"
    for v, kind in (("a@b.co", "email"), ("123-45-6789", "ssn"), ("(555) 123 4567", "phone"), ("Foo LLC", "company"), ("Northwind Trading Post", "company"), ("Jane Doe", "person"), (" ", None)):
        assert value(T.guess_type(c), v) == kind
    for name, kind, base in (("a/B.DOCX", "docx", "B"), (".docx", None, ".docx"), ("x.tar.pdf", "pdf", "x.tar"), ("p.HEIC", "image", "p"), ("", None, "document")):
        assert (value(T.kind_of(c), name), value(T.base_name(c), name)) == (kind, base)
    home = "/Users/u"
    for path, provider in (("/Users/u/Library/CloudStorage/GoogleDrive-x@y/z", "Google Drive"), ("/Users/u/Dropbox/a", "Dropbox"), ("/Users/u/Documents", None), ("/Users/u/Library/Mobile Documents/com~apple~CloudDocs", "iCloud Drive")):
        assert value(T.sync_provider(c, F.lit(home)), path) == provider
    for token, label in (("Statement Date", True), ("Remittance Slip", True), ("Sunny Electricity", False), ("123", True)):
        assert value(T.is_form_label(c), token) is label


def test_pictures(spark):
    rects = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate([(0, 0, 10, 10), (30, 0, 40, 10), (200, 200, 260, 260), (5, 5, 5.5, 90)])], "page_id long, rect_id int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(tuple(r)[1:] for r in providers.clusters(rects).collect()) == [(0, 0, 40, 10), (200, 200, 260, 260)]


def test_stream(spark, tmp_path):
    from tagveil.streaming.arrivals import redact_stream

    docs(spark, "Quarry wrote.", "nothing").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    redact_stream(stream, entries(spark), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert {r.redacted_text for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"[[YARD_2]] wrote.", "nothing"}


def test_stream_holds_back_and_learns_once(spark, tmp_path):
    pairs = [("x a", "[[T0]]"), ("a a", "[[T1]]"), ("Quarry", "[[YARD]]")]
    spark.createDataFrame([(1, "Quarry wrote."), (2, "x a a a"), (None, "x a a a"), (None, "by Quarry, Quarry"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    engine = Engine(spark, f"{tmp_path}/d.json", f"{tmp_path}/m")
    real, tries = engine.dictionary.upsert, []

    def failing_once(new):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("the store is away")
        return real(new)

    engine.dictionary.upsert = failing_once
    stream = lambda: spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception):
        engine.redact_stream(stream(), entries(spark, pairs), f"{tmp_path}/out", f"{tmp_path}/ck", "job").awaitTermination(60)
    engine.redact_stream(stream(), entries(spark, pairs), f"{tmp_path}/out", f"{tmp_path}/ck", "job").awaitTermination(60)
    assert len(tries) == 2
    assert sorted(r.redacted_text or "" for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["", "[[YARD]] wrote.", "by [[YARD]], [[YARD]]"]
    assert sorted((str(r.doc_id), r.leaked) for r in spark.read.parquet(f"{tmp_path}/out_held").collect()) == [("2", ["a a"]), ("None", ["a a"])]
    assert engine.mappings.count() == 1 and [(r.tag, r.value, r.n) for r in engine.mappings.all_entries().collect()] == [("[[YARD]]", "Quarry", 3)]
    assert sorted(r.term for r in engine.dictionary.load().collect()) == ["Quarry", "a a", "x a"]


def test_many_mappings_are_read_by_tasks(spark, tmp_path):
    folder = tmp_path / "m 1"
    folder.mkdir()
    for k in range(600):
        (folder / f"job-{k}.json").write_text(f'{{"source": "s{k}", "entries": [{{"tag": "[[T_{k % 200}]]", "value": "v{k}", "count": 1}}]}}')
        os.utime(folder / f"job-{k}.json", (1000 + k, 1000 + k))
    (folder / "notes.txt").write_text("no mapping")
    store = stores.MappingStore(spark, folder)
    assert store.count() == 600 and store.recent(3).select("mapping_id").collect() == [("job-599",), ("job-598",), ("job-597",)]
    newest = store.all_entries().orderBy("ord").collect()
    assert [(r.tag, r.value) for r in newest] == [(f"[[T_{k}]]", f"v{400 + k}") for k in range(200)]
    assert store.forget("job-599") and not store.forget("job-599") and store.count() == 599
    assert store.all_entries().where("tag = '[[T_199]]'").first().value == "v399"
    assert store.get("job-5").startswith('{"source": "s5"') and store.get("../x") is None and store.get("job-599") is None
    store.save("job-5", "[]")
    assert store.get("job-5") == "[]" and store.count() == 599 and oct((folder / "job-5.json").stat().st_mode & 0o777) == "0o600"


def test_report_over_whole_mappings(spark):
    mapping = spark.range(10_050).select(F.expr("'[[T_' || id || ']]'").alias("tag"), F.expr("'v' || id").alias("value"), F.col("id").alias("ord"))
    drafts = docs(spark, "a [[T_7]] and [[ t 10049 ]]", "nothing")
    found, _ = restore.restored(drafts, mapping)
    rows = restore.report(drafts, mapping, found)
    assert rows.count() == 2 * 10_050
    assert {tuple(r) for r in rows.where("replaced + mangled > 0").collect()} == {(0, "[[T_7]]", 1, 0), (0, "[[T_10049]]", 0, 1)}
    own = spark.createDataFrame([(0, "[[T_7]]"), (0, "[[T_8]]"), (1, "[[T_7]]")], "doc_id long, tag string")
    assert {tuple(r) for r in restore.report(drafts, own, found).collect()} == {(0, "[[T_7]]", 1, 0), (0, "[[T_8]]", 0, 0), (1, "[[T_7]]", 0, 0)}


def test_word_files_are_held_back(spark, tmp_path):
    pairs = [("Orbit Mills", "[[CO]]"), ("x a", "[[T0]]"), ("a a", "[[T1]]")]
    contents = {1: docx.plain_docx(["by Orbit Mills, Orbit Mills"]), 2: docx.plain_docx(["by Orbit", "Mills"]), 3: docx.plain_docx(["x a a a"]), 4: b"nozip", 5: docx.plain_docx([""])}
    files = spark.createDataFrame(list(contents.items()), "doc_id long, content binary")
    engine = Engine(spark, f"{tmp_path}/d.json", f"{tmp_path}/m")
    got = {r.doc_id: r for r in engine.redact_files(files, entries(spark, pairs), "job-1").collect()}
    assert {d: (r.ok, r.content is not None, r.leaked) for d, r in got.items()} == {1: (True, True, []), 2: (False, False, ["Orbit Mills"]), 3: (False, False, ["a a"]), 4: (False, False, []), 5: (True, True, [])}
    assert got[4].error and engine.mappings.count() == 0 and engine.dictionary.load().count() == 0
    assert engine.redact_files(files.where("doc_id in (1, 5)"), entries(spark, pairs), "job-2").where("ok").count() == 2
    assert [(r.tag, r.value, r.n) for r in engine.mappings.all_entries().collect()] == [("[[CO]]", "Orbit Mills", 2)]
    assert engine.dictionary.load().count() == 3


def test_many_terms_without_ascii_words(spark):
    pairs = [("ж" * (1 + i % 40) + "я" * (1 + i // 40), f"[[N_{i}]]") for i in range(1001)]
    out = redacted(spark, pairs, f"это {pairs[0][0]} и {pairs[1000][0]} тут")[0]
    assert out.ok and out.redacted_text == "это [[N_0]] и [[N_1000]] тут"


def test_rows_are_judged_by_their_own_text(spark):
    frame = spark.createDataFrame([(None, "Bob here"), (None, "no one"), (1, "Bob one"), (1, "Bob two Bob"), (1, "Bob one"), (2, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.ok, r.n_matches, r.redacted_text or "") for r in redact.redact(frame, entries(spark, [("Bob", "[[P_1]]")])).collect()))
    assert got == sorted([(0, True, 1, "[[P_1]] here"), (0, True, 0, "no one"), (1, True, 1, "[[P_1]] one"), (1, True, 2, "[[P_1]] two [[P_1]]"), (1, True, 1, "[[P_1]] one"), (2, True, 0, ""), (0, True, 0, "")])
    held = redact.redact(frame.where("doc_id is null"), entries(spark, [("Bob x", "[[P_1]]"), ("Bob", "[[BOB]]")])).where("not ok").collect()
    assert [r.redacted_text for r in held] == [None] and held[0].leaked == ["Bob"]
    assert [(r.ok, r.leaked) for r in redact.gate(frame.withColumnRenamed("text", "new_text").where("doc_id is null"), entries(spark, [("bob", "[[P]]")])).orderBy("ok").collect()] == [(False, ["bob"]), (True, []), (True, [])]
    mapping = spark.createDataFrame([("[[P_1]]", "Bob", 0)], "tag string, value string, ord long")
    back = restore.restore(spark.createDataFrame([(None, "[[P_1]] a"), (3, "b [[p 1]]"), (3, "c")], frame.schema), mapping).collect()
    assert sorted(r.restored_text for r in back) == ["Bob a", "b Bob", "c"]
    mails = spark.createDataFrame([(None, "a@b.co"), (None, "a@b.co c@d.co"), (5, "x@y.co"), (5, "z@y.co z@y.co"), (5, "x@y.co")], frame.schema)
    rows = detect.analyze(mails, entries(spark, [])).collect()
    assert sorted((r.doc_id or 0, r.pos, r.term, r.tag, r.n) for r in rows) == [(0, 1, "a@b.co", "[[EMAIL_1]]", 1), (0, 1, "a@b.co", "[[EMAIL_1]]", 1), (0, 2, "c@d.co", "[[EMAIL_2]]", 1), (5, 1, "x@y.co", "[[EMAIL_1]]", 1), (5, 1, "z@y.co", "[[EMAIL_1]]", 2)]
    assert redact.redact(frame.where("false"), entries(spark, [("Bob", "[[P]]")])).count() == 0


def test_terms_of_any_script_are_found_by_equality(spark):
    import random

    rng = random.Random(3)
    letters = {"ru": "абвгдежзиклмнопрстуфя", "zh": "".join(chr(i) for i in range(0x4E00, 0x4F00)), "el": "αβγδεζηθικλμνξοπρστυφχψω"}
    words = [f"{k}{''.join(rng.choice(a) for _ in range(rng.choice((2, 3, 5))))}"[2:] for k, a in letters.items() for _ in range(2400)]
    pairs = [(w, f"[[N_{i}]]") for i, w in enumerate(dict.fromkeys(words))]
    assert len(pairs) > 5000
    chosen = rng.sample(pairs, 60)
    texts = ["-".join(w.upper() for w, _ in chosen[i : i + 3]) for i in range(0, 60, 3)]
    rules = matching.term_rules(entries(spark, pairs))
    got = {(r.doc_id, r.ord) for r in matching.exploded(matching.candidates(docs(spark, *texts), rules), "candidates").select("doc_id", "ord").distinct().collect()}
    want = {(d, o) for d, t in enumerate(texts) for o, (w, _) in enumerate(pairs) if w in t.lower().replace("ς", "σ")}
    assert got == want and len(want) >= 60
    # letters that the search takes for the same, single characters, marks, and rules within words
    odd = {"İstanbul": "in istanbul", "ΟΔΟΣ": "οδος", "µm": "ΜM", "王": "小王子", "--": "a -- b", "ſun": "SUN", "вода": "ᲀода"}
    for i, (term, text) in enumerate(odd.items()):
        one = matching.matches(docs(spark, text), matching.term_rules(entries(spark, [(term, "[[X]]")]))).first()
        assert len(one.matches) == 1, (i, term)
    inner = matching.matches(docs(spark, "unbelievable"), matching.term_rules(entries(spark, [("LIE", "[[X]]")]), whole_word=False)).first()
    assert [(m.s, m.e) for m in inner.matches] == [(4, 7)]


W14 = 'xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="w14"'


def zipped(parts, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def test_rewriting_touches_text_nodes_only(spark):
    w = docx._W[1:-1]
    body = f"""<?xml version='1.0'?>\n<w:document xmlns:w="{w}" {W14}><!-- Quarry --><w:body><w:p w14:paraId='1'><w:r><w:t xml:space='default' >Quarry &amp; </w:t><w:t/></w:r></w:p>\r\n<w:p><w:r><w:t>caf\u00e9 </w:t></w:r><w:txbx><w:p><w:t>in Quarry</w:t></w:p></w:txbx><w:r><w:t><![CDATA[Qua]]>rry</w:t></w:r></w:p></w:body></w:document>"""
    other = f'<w:hdr xmlns:w="{w}" {W14}><w:p><w:r><w:t>none</w:t></w:r></w:p></w:hdr>'
    wide = f'<?xml version="1.0" encoding="UTF-16"?><w:ftr xmlns:w="{w}"><w:p><w:t>Quarry</w:t></w:p></w:ftr>'
    content = zipped({"word/document.xml": body, "word/header1.xml": other, "word/footer1.xml": wide.encode("utf-16"), "x.bin": b"Quarry"})
    files = spark.createDataFrame([(None, content), (None, zipped({"word/document.xml": f'<w:d xmlns:w="{w}"><w:p><w:t>Quarry 2</w:t></w:p></w:d>'})), (3, docx.plain_docx(["a"])), (3, docx.plain_docx(["Quarry"]))], "doc_id long, content binary")
    rows = docx.redacted(files, entries(spark)).collect()
    assert all(r.ok for r in rows) and "[[YARD_2]] 2" in {r.text for r in rows}
    new = next(bytes(r.content) for r in rows if "caf" in r.text)
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        got = z.read("word/document.xml").decode()
        assert z.read("word/header1.xml").decode() == other and z.read("x.bin") == b"Quarry"
        assert "[[YARD_2]]" in z.read("word/footer1.xml").decode()
    want = body.replace("<w:t xml:space='default' >Quarry &amp; </w:t>", '<w:t  xml:space="preserve">[[YARD_2]] &amp; </w:t>').replace("in Quarry", "in [[YARD_2]]").replace("<![CDATA[Qua]]>rry", "[[YARD_2]]")
    assert got.replace("<w:t  ", "<w:t ").replace(" >", ">") == want.replace("<w:t  ", "<w:t ").replace(" >", ">")
    assert sorted(r.text for r in rows if r.doc_id == 3) == ["[[YARD_2]]", "a"]


def test_files_that_cannot_be_read_are_rows_with_an_error(spark):
    good = bytearray(zipped({"word/document.xml": f'<w:d xmlns:w="{docx._W[1:-1]}"><w:p><w:t>Quarry</w:t></w:p></w:d>'}))
    at = good.index(b"PK\x01\x02")
    locked, odd, torn = bytearray(good), bytearray(good), bytearray(good)
    for flags in (6, at + 8):
        locked[flags] |= 1  # marked as encrypted
    for method in (8, at + 10):
        odd[method] = 9  # a packing that is not known
    torn[60:64] = b"\xff\xff\xff\xff"
    broken = zipped({"word/document.xml": b"<a>\xff</a>"})
    files = spark.createDataFrame([(i, bytes(c)) for i, c in enumerate((good, locked, odd, torn, broken, b"", good[:40]))] + [(7, None)], "doc_id long, content binary")
    rows = {r.doc_id: r for r in docx.redacted(files, entries(spark)).collect()}
    assert rows[0].ok and rows[0].text == "[[YARD_2]]"
    assert [(i, rows[i].ok, rows[i].content, bool(rows[i].error)) for i in range(1, 8)] == [(i, False, None, True) for i in range(1, 8)]


def test_kept_pictures_are_embedded(spark):
    png = b"\x89PNG made up"
    files = spark.createDataFrame([(1, docx.plain_docx(["a"])), (2, b"nozip")], "doc_id long, content binary")
    pictures = spark.createDataFrame([(1, 0, png, 40, 80), (1, 3, png, 40, 40), (2, 0, png, 1, 1)], "doc_id long, image_id int, png binary, width int, height int")
    rows = {r.doc_id: bytes(r.content) for r in docx.embedded(files, pictures).collect()}
    assert rows[2] == b"nozip"
    with zipfile.ZipFile(io.BytesIO(rows[1])) as z:
        from xml.etree import ElementTree

        assert [z.read(f"word/media/kept{i}.png") for i in (0, 1)] == [png] * 2
        assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist() if n.endswith((".xml", ".rels")))
        assert z.read("word/document.xml").count(b"r:embed=") == 2


def test_reading_files_of_all_kinds(spark):
    from tagveil.sources import ingest

    files = spark.createDataFrame([(1, "a.docx", docx.plain_docx(["Quarry"])), (2, "b.pdf", b"x"), (3, "c.png", b"x"), (4, "d.txt", b"x"), (5, "e.docx", b"x"), (6, "f.docx", docx.plain_docx([" "]))], "doc_id long, name string, content binary")
    got = {r.doc_id: r for r in ingest.read(files).collect()}
    assert got[1].text == "Quarry" and got[1].error is None
    assert [got[i].error for i in (2, 3, 4, 6)] == ["no reader for pdf", "no reader for image", ingest.NO_KIND, ingest.NO_TEXT] and got[5].error.startswith("BadZipFile")
    plugged = providers.Providers(ocr=lambda f: f.selectExpr("doc_id", "1.0 as y", "explode(array(2.0, 1.0)) as x", "'w' as text"), pdf=lambda f: f.selectExpr("doc_id", "'' as text"))
    got = {r.doc_id: r for r in ingest.read(files, plugged).collect()}
    assert got[3].text == "w\nw" and got[2].error == ingest.NO_TEXT
    # ids that are missing or repeated: each file has its own text
    said = lambda f: f.selectExpr("doc_id", "0 as y", "0 as x", "cast(content as string) as text")
    odd = [(None, "a.docx", docx.plain_docx(["one"])), (None, "b.docx", docx.plain_docx(["two"])), (7, "c.docx", docx.plain_docx(["three"])), (7, "d.png", b"four"), (7, "e.png", b"five"), (None, "e.png", b"five"), (7, "e.png", b"five"), (None, "f.docx", None), (None, None, b"x")]
    rows = ingest.read(spark.createDataFrame(odd, "doc_id long, name string, content binary"), providers.Providers(ocr=said)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted([("None", "one"), ("None", "two"), ("7", "three"), ("7", "four"), ("7", "five"), ("None", "five"), ("7", "five"), ("None", "None"), ("None", "None")])


def test_stores_on_odd_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    store = stores.MappingStore(spark, f"{tmp_path}/m")
    for name, text in (("a", '{"entries": [{"tag": "[[X]]", "value": "v", "count": 1}]}'), ("b", "{broken"), ("c", "{}"), ("d", "7")):
        store.save(name, text)
    assert {(r.mapping_id, r.n) for r in store.recent().collect()} == {("a", 1), ("c", 0)}
    (tmp_path / "dictionary.json").write_text('{"entries": null}')
    assert stores.dictionary_path("/x/y.json", str(tmp_path)).as_posix() == "/x/y.json"
    path = stores.dictionary_path(None, str(tmp_path))
    assert path.name == "terms.json" and path.exists() and stores.Dictionary(spark, path).load().count() == 0
    with pytest.raises(ValueError):
        stores.Dictionary(spark, path).move(f"{path}/inside/d.json")
    with pytest.raises(ValueError):
        stores.resolve(stores.parse(spark.createDataFrame([], "mapping_id string, json string")).withColumn("saved_at", F.lit(0)))


def test_tags_for_typed_values(spark):
    from tagveil.operators.mint import next_tag

    wanted = spark.createDataFrame([(0, "company"), (1, "other"), (2, "company"), (3, None)], "ord long, type string")
    taken = spark.createDataFrame([("[[company_1]]",), ("[[COMPANY_3]]",)], "tag string")
    assert [r.tag for r in next_tag(wanted, taken).orderBy("ord").collect()] == ["[[COMPANY_2]]", "[[CUSTOM_1]]", "[[COMPANY_4]]", "[[CUSTOM_2]]"]


def test_fold_agrees_with_the_jvm_on_all_planes(spark):
    points = [(i, chr(i)) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    frame = spark.createDataFrame(pd.DataFrame(points, columns=["i", "c"]))
    # what neither function changes is in no case pair
    cased = frame.where("lower(c) != c or upper(c) != c").select("i", "c", T.fold(F.col("c")).alias("folded")).collect()
    assert len(cased) > 2000
    of_jvm, classes = spark._jvm.java.lang.Character, {}
    for r in cased:
        classes.setdefault(of_jvm.toLowerCase(of_jvm.toUpperCase(r.i)), []).append((r.c, r.folded))
    assert all(len({f for _, f in own}) == 1 for own in classes.values())
    assert all(len(f) == 1 for own in classes.values() for _, f in own)
    # and the search does take the letters of a class as equal
    pairs = [(own[0][0], c) for own in classes.values() for c, _ in own[1:]]
    met = spark.createDataFrame(pairs, "a string, b string").select(F.regexp_like("b", F.concat(F.lit("(?iU)"), "a")).alias("met"), "a", "b")
    assert {r.a + r.b for r in met.where("not met").collect()} <= {"\u00df\u1e9e"}  # folded for nothing, which only adds candidates
    found = redacted(spark, [("\u03b9\u03bf\u03bd", "[[T]]")], "a \u1fbe\u03bf\u03bd", "\u0345\u039f\u03bd")
    assert [found[i].redacted_text for i in (0, 1)] == ["a [[T]]", "[[T]]"]


def test_rules_that_share_their_words(spark):
    pairs = [(f"the a{i % 50} b{i // 50}", f"[[P_{i}]]") for i in range(2500)] + [("the", "[[THE]]"), ("rare the", "[[R]]"), ("a1-b2", "[[H]]"), ("the a7", "[[S]]")]
    rules = matching.term_rules(entries(spark, pairs))
    assert rules.groupBy("anchor").count().agg(F.max("count")).first()[0] <= 50
    texts = ["The a3\n b7 or a7 b3 the", "rare  THE a49 b49", "A1-B2, a1 b2, the a1 b2", "the [[a7 b7]] the a7", ""]
    met = matching.with_rules(docs(spark, *texts), rules).select(F.size("rules").alias("n")).collect()
    assert all((r.n or 0) <= 8 for r in met)
    got = redacted(spark, pairs, *texts)
    for i, text in enumerate(texts):
        new = plain_redaction(text, pairs)
        left = plain_leaks(new, pairs)
        assert (got[i].redacted_text, got[i].leaked) == (None if left else new, left), text


def test_dictionary_on_any_filesystem(spark, tmp_path):
    def rows(d):
        return [(r.term, r.tag, r.source) for r in d.load().orderBy("ord").collect()]

    def pairs(*terms):
        return spark.createDataFrame([(t, f"[[{t[0]}]]", None, i) for i, t in enumerate(terms)], "term string, tag string, source string, ord long")

    home = f"file:{tmp_path}/a b"
    one = stores.Dictionary(spark, f"{home}/terms.json")
    assert one.load().isEmpty() and one.upsert(pairs("Äther", "b")).count() == 2
    assert rows(one) == [("Äther", "[[Ä]]", "manual"), ("b", "[[b]]", "manual")]
    assert oct((tmp_path / "a b/terms.json").stat().st_mode & 0o777) == "0o600" and [p.name for p in (tmp_path / "a b").iterdir() if not p.name.startswith(".")] == ["terms.json"]
    # the same file by its plain path is the same place
    assert one.move(f"{tmp_path}/a b/terms.json") is one and rows(stores.Dictionary(spark, f"{tmp_path}/a b/terms.json")) == rows(one)
    two = stores.Dictionary(spark, f"{home}/other/terms.json")
    two.save(pairs("c", "B."))
    moved = one.move(two.path)
    assert [r[0] for r in rows(moved)] == ["c", "b", "Äther"] and one.load().isEmpty()
    assert [r[0] for r in rows(moved.reset(one.path))] == ["c", "b", "Äther"] and not moved.load().isEmpty()
    for text in ("{broken", "7", '{"entries": null}', ""):
        (tmp_path / "a b/odd.json").write_text(text)
        assert stores.Dictionary(spark, f"{home}/odd.json").load().isEmpty()
    moved.clear()
    moved.clear()
    assert moved.load().isEmpty()


def test_pictures_of_odd_files(spark):
    files = spark.createDataFrame([(1, docx.plain_docx(["a"])), (1, docx.plain_docx(["a"])), (None, docx.plain_docx(["b"])), (2, b"nozip"), (3, None)], "doc_id long, content binary")
    kept = spark.createDataFrame([(1, 5, b"x", 10, 20), (1, 4, b"", 10, 10), (None, 0, b"y", 0, 0), (2, 0, b"z", 1, 1), (9, 0, b"w", 1, 1)], "doc_id long, image_id int, png binary, width int, height int")
    wide = docx.PICTURE_WIDTH
    found = sorted(((r.doc_id or 0, r.at, bytes(r.png), r.width, r.height) for r in docx.pictures(docx.embedded(files, kept)).collect()))
    assert found == [(0, 0, b"y", wide, wide), (1, 0, b"", wide, wide), (1, 0, b"", wide, wide), (1, 1, b"x", wide, 2 * wide), (1, 1, b"x", wide, 2 * wide)]
    assert docx.pictures(files).isEmpty() and docx.pictures(files.where("false")).isEmpty()
