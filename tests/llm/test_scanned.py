import random

from foliary.llm.scanned import Editor, PageReader, Reader, apply_edits, edits_of, furniture, head_key, page_values, read_scans, repaired_documents, scan_defects, word_counts

WORDS = "the pump must be tested before first flight and valve is replaced after each landing by crew operator load-bearing low-pressure hydraulic component inspection interval recorded card".split()


def pages(seed=1, docs=20, per=4):
    """Pages with heads, numbers, cut words and misread characters, and where they are."""
    r = random.Random(seed)
    rows, truth = [], set()
    for d in range(docs):
        for p in range(1, per + 1):
            lines = [f"Manual XY-{1000 + d}  Issue 3"]
            truth.add((d, p, 1, "running_head"))
            for n in range(12):
                ws = [r.choice(WORDS) for _ in range(9)]
                if r.random() < 0.06:
                    at = next((i for i, w in enumerate(ws[1:-1], 1) if "e" in w and len(w) > 5 and "-" not in w), None)
                    if at:
                        ws[at] = ws[at].replace("e", "c", 1)
                        truth.add((d, p, len(lines) + 1, "misread"))
                lines.append(" ".join(ws))
                if r.random() < 0.2 and n < 11:
                    lines[-1] += " inspec-"
                    truth.add((d, p, len(lines), "hyphen_break"))
                    lines.append("tion " + " ".join(r.choice(WORDS) for _ in range(5)))
            lines.append(f"- {p} -")
            truth.add((d, p, len(lines), "page_number"))
            rows.append((d, p, "\n".join(lines)))
    return rows, truth


def test_defects_found(spark):
    rows, truth = pages()
    df = spark.createDataFrame([(*x, 0) for x in rows + rows[:3]] + [(99, 1, None, 0), (98, 1, "", 0), (None, 1, "x", 0)], "document_id long, page_number int, text string, line_no int")
    got = {tuple(r) for r in scan_defects(df).collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert scan_defects(df.limit(0)).count() == 0
    full = {r.document_id: r.text for r in repaired_documents(df).collect()}
    assert "inspection" in full[0] and "Issue 3" not in full[0] and "\n" not in full[0].replace("\n\n", "")
    assert {r.doc for r in read_scans(df).select("doc").collect()} == {*range(20), 98}


def test_compounds_are_no_breaks():
    counts = {w: 50 for w in WORDS} | {"low": 60, "pressure": 60, "load": 60, "bearing": 60}
    pr = PageReader(Reader.teach(counts))
    assert pr.breaks("test the low-", "pressure pump") is None
    assert pr.breaks("the inspec-", "tion of") == ("inspec", "tion")
    assert pr.breaks("the inspec¬", "tion of") == ("inspec", "tion")
    assert pr.breaks("no mark here", "tion") is None and pr.breaks("part XY-", "1234") is None


def test_page_numbers_and_heads():
    assert page_values("Page 3 of 9") == [3] and page_values("— 12 —") == [12] and page_values("iv") == [4] and 12 in page_values("p. l2") and page_values("12 bolts are fitted") == []
    assert head_key("MANUAL X  Rev 3   17") == head_key("Manual X rev 4  18")
    lines = ["Manual X", "a body line", "another", "more", "7"]
    assert furniture(lines, 7, ["manual x"], [0]) == {0: "running_head", 4: "page_number"}


def test_lexicon_keeps_the_same_words_at_every_size(spark):
    line = "x " + "the pump valve crew " * 2000 + "y"
    rows = [("\n".join([line] * 8),)] * 60 + [("x torquemeter y\nx cross-feed y\nx onceonly y",)] * 5
    counts = word_counts(spark.createDataFrame(rows, "text string"))
    assert counts["pump"] == 60 * 8 * 2000 and counts["torquemeter"] == counts["cross-feed"] == 5
    lexicon = Reader.teach(counts).counts
    assert {"torquemeter", "cross-feed", "pump"} <= set(lexicon)
    few = word_counts(spark.createDataFrame([(f"x rare{chr(97 + i)}{chr(97 + j)} y",) for i in range(26) for j in range(26)] + [("x pump y",)] * 5, "text string"), most_rare=50)
    assert few["pump"] == 5 and 10 < len(few) < 120


def test_lost_letters_are_put_back():
    """Where words lose a letter again and again, the editor learns to insert it."""
    r = random.Random(5)
    stems = "insp rec comp mark oper mont contr sust alt corr".split()
    counts = {f"{a}{b}ion{c}": 400 for a in stems for b in ("ect", "ord", "ut", "ress") for c in ("", "al", "s")}
    lost = {w.replace("ion", "on"): w for w in sorted(counts) if r.random() < 0.4}
    reader = Reader.teach(counts | {k: 3 for k in lost})
    put = {k: reader.repair(k) for k in lost}
    assert sum(bool(v) and v[0] == lost[k] for k, v in put.items()) / len(lost) > 0.8
    assert any(o.startswith("ins:") for v in put.values() if v for o in v[1]) and all(reader.repair(w) is None for w in counts)
    assert apply_edits("vave", edits_of("vave", "valve", 2, "", "l")) == "valve"


def test_joining_of_unknown_words_is_learnt():
    counts = {w: 50 for w in WORDS} | {w + s: 20 for w in WORDS if "-" not in w for s in ("ing", "able", "ment")} | {f"{a}-{b}": 30 for a in ("low", "high", "rear", "self") for b in ("pressure", "landing", "bearing", "locking")}
    counts |= {w: 60 for w in ("low", "high", "rear", "self", "pressure", "landing", "bearing", "locking")}
    pr = PageReader(Reader.teach(counts))
    assert pr.breaks("it is preheat-", "ment here") == ("preheat", "ment") and pr.breaks("a rear-", "valve here") is None
    assert Editor().fit_joins([(["a"], True), (["b"], False)] * 9).joins(["a"]) and not Editor().fit_joins([(["a"], True), (["b"], False)] * 9).joins(["b"])


def test_words_cut_across_pages_behind_much_furniture(spark):
    """The next page's first body line counts, however many lines of furniture or blanks stand before it."""
    rows, _ = pages(3, docs=6, per=3)
    rows = [(d, p, t.replace(f"\n- {p} -", " inspec-\n" + f"- {p} -") if p == 1 else t.replace("Issue 3\n", "Issue 3" + "\n " * 900 + "\ntion ", 1) if p == 2 else t) for d, p, t in rows]
    got = {tuple(r) for r in scan_defects(spark.createDataFrame(rows, "document_id long, page_number int, text string")).collect()}
    lines = {(d, p): t.split("\n") for d, p, t in rows}
    assert all((d, 1, len(lines[d, 1]) - 1, "hyphen_break") in got for d in range(6))
