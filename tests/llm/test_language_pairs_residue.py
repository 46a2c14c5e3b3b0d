import random

import numpy as np

from foliary.llm.crf import feature_ids
from foliary.llm.language import LANGUAGES, cautions, detect_languages, label_language, labelled_windows, named_language, paragraphs, train, wrong_languages
from foliary.llm.pairs import Tagger, bare_code, clauses, defective_pairs, sample_pairs, says_nothing
from foliary.llm.residue import TemplateTree, has_slot, residue_ids, template_of, verdict, without_residue

EN = "The pump must be tested before the first flight and the valve is replaced after each landing by the crew."
FR = "La pompe doit être contrôlée avant le premier vol et la vanne est remplacée après chaque atterrissage."


def test_labels_and_paragraphs():
    assert [named_language(x) for x in ("EN", "en_US", "français", "deu", "unk", None, "", "??")] == ["en", "en", "fr", "de", None, None, None, None]
    assert paragraphs("a\r\n \r\nb\n\n\nc\n") == ["a", "b", "c\n"]


def test_languages(spark, net):
    rows = [(1, f"{EN} {EN}\n\n{FR}\n\n{EN}", "English"), (2, f"{FR} {FR}", "en"), (3, f"{EN} {EN}", None), (4, None, "en"), (5, "", "en"), (6, "short", "fr"), (2, f"{FR} {FR}", "en"), (7, EN * 3000, "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "id long, text string, lang string, confidence double")
    found = detect_languages(df, "id", "text", "lang", net)
    assert all(0 <= r.confidence <= 1.000001 for r in found.collect())
    assert {tuple(r) for r in wrong_languages(found).collect()} == {(1, 2, "fr"), (2, 0, "fr"), (3, 0, "en")}
    assert wrong_languages(detect_languages(df.limit(0), "id", "text", "lang", net)).count() == 0


def test_label_expression_equals_the_function(spark):
    labels = ["EN", "en_US", "français", "deu", "unk", None, "", "??", " Italian ", "es-ES", "xx-en"]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r[0] for r in df.select(label_language(df.l)).collect()] == [named_language(x) for x in labels]


def test_windows_looked_up_equal_the_products(net):
    from foliary.llm.language import windows

    x = np.concatenate([windows(t) for t in (EN, FR, EN * 20, "é", "")])
    h, _ = net.pooled(x)
    z = np.maximum(h, 0) @ net.out + net.out_bias
    assert np.allclose(net.log_probs(x), z - np.logaddexp.reduce(z, axis=1, keepdims=True), atol=1e-4)


def test_samples_do_not_depend_on_the_partitions(spark, data):
    texts, asked = spark.read.parquet(f"{data}/extractions.parquet"), spark.read.parquet(f"{data}/feedback.parquet")
    two = [labelled_windows(df, "text", "language", most=40) for df in (texts.coalesce(1), texts.repartition(7))]
    assert len(two[0].y) == 40 and (two[0].x == two[1].x).all() and (two[0].y == two[1].y).all() and (two[0].short_x == two[1].short_x).all()
    a, b = (sample_pairs(df, "question", ["answer_text", "suggested_answer"], 25) for df in (asked.coalesce(1), asked.repartition(5)))
    assert a == b and 10 < len(a) <= 25


def test_short_paragraphs_contradict_only_where_that_is_safe(spark, data):
    sample = labelled_windows(spark.read.parquet(f"{data}/extractions.parquet"), "text", "language", most=600)
    assert all(0.6 <= c <= 1.1 for c in cautions(train(sample.x, sample.y), sample))


def test_bare_references():
    assert all(map(bare_code, ["GM1 25.558", "AMC 25.1158(a)", "CS-E 29.864", "XP-1280-G"])) and not any(map(bare_code, ["See CS 25.1", "12 bolts", "- Rotor, 12 V", "", "Yes."]))


def test_nothing_said():
    assert all(map(says_nothing, [None, "", " \n", "...", "<br/>", "**Answer:**", "n/a", "None", "Réponse :", "—"]))
    assert not any(map(says_nothing, ["No.", "Yes.", "Non.", "5 bar", "Answer: it is 5"]))


def test_pair_defects(spark, net):
    r = random.Random(0)
    things = ["pump", "valve", "rotor", "seal", "filter", "hinge"]
    sound = [(f"When must the {a} {b} be tested after a landing?", f"The {b} {a} is tested every {r.randint(2, 90)} days. It is replaced by the crew after {r.randint(2, 9)} flights.") for a in things for b in things for _ in range(6)]
    french = [(f"Quand faut-il contrôler la pompe {i} après un vol ?", f"La pompe {i} est contrôlée tous les {i + 2} jours. Elle est remplacée par le personnel après le vol.") for i in range(60)]
    tagger = Tagger(net).teach(sound + french)
    q = "When must the pump seal be tested after a landing?"
    cases = {
        "a": "The seal is tested every 12 days.", "b": "The seal is tested every 12 days. It is repl", "c": "I am sorry, but I cannot answer questions about the pump seal.",
        "d": "When must the pump seal be tested after a landing?", "e": "La pompe est contrôlée tous les 12 jours. Elle est remplacée par le personnel après le vol.", "f": None, "g": "n/a", "h": "Yes.",
        "i": q + " The seal is tested every 12 days. It is replaced by the crew after 3 flights.",
    }
    rows = [(k, q, v, None, 1) for k, v in cases.items()] + [("a", q, cases["a"], None, 1), ("j", None, "The seal is tested every 12 days.", "", 1)]
    df = spark.createDataFrame(rows, "id string, question string, ans string, sug string, defect int")
    got = {(x.id, x.answer_field, x.defect) for x in defective_pairs(df, "id", "question", ["ans", "sug"], tagger, ("ans",)).collect()}
    want = {"b": "truncated_answer", "c": "refusal", "d": "copies_question", "e": "other_language", "f": "empty_answer", "g": "empty_answer"}
    assert {(k, "ans", d) for k, d in want.items()} == {g for g in got if g[0] != "j"}
    assert defective_pairs(df.limit(0), "id", "question", ["ans"], tagger).count() == 0
    assert len(clauses("One. Two!\n- a\n- b")) == 4


def test_long_clauses_are_read_to_their_end(net):
    tagger = Tagger(net)
    long_fr = f"{EN} " + FR[:-1].replace(".", ",") * 6
    langs = tagger.languages([EN, FR, long_fr, f"{FR} " + EN[:-1] * 6, "pump"])
    assert langs.shape == (5, 5) and np.allclose(np.exp(langs).sum(axis=1), 1, atol=1e-4)
    assert [LANGUAGES[k] for k in langs.argmax(axis=1)][:4] == ["en", "fr", "fr", "en"]
    start = " ".join(f"word{chr(97 + i)}" for i in range(24)) + " and so on through many other words, until "
    a, b = (tagger.features("What is it?", [start + x], langs[0], langs[:1])[0] for x in ("it works.", "i must decline to comment."))
    assert set(feature_ids(["w=decline", "b=must decline"])) <= set(b) and not set(feature_ids(["w=decline"])) & set(a)


def test_slots():
    assert all(map(has_slot, ["value {{ part_no }} kg", "by <TITLE> bolts", "%LIMIT_MAX% N", "[INSERT DATE] was", "__REF__ x", "@@A@@", "«author.name» x", "XX/XX/XXXX", "${x_y}", "due &lt;date&gt;"]))
    assert not any(map(has_slot, ["the field `{{effective_date}}` is", "Writers must not leave marks such as [INSERT DATE] in it.", "range {min, max} and [i]", "[ ] to do", "<|endoftext|> x", "« une citation » et 5 %", "[illisible]", "a <b>bold</b> word"]))


def test_slots_beside_words_of_speaking():
    held = ["%VALUE1% Leck wurde gefunden, worauf das geschirmte Relais ersetzt wurde.", "The crew replaces {{part_no}} with a new valve.", "Field tests took {{limit_max}} days.", "Il campo è chiuso dopo [[limit_max]] ore.", "Leave {{valve_no}} open; the marks are red.", "Il remplace le joint, pièce <<part_no>>, du champ avant."]
    spoken = ["Les rédacteurs ne laissent jamais de marque [À COMPLÉTER] dans un bulletin diffusé.", "No marks such as [INSERT DATE], [FILL IN NAME] or {{title}} are left.", "The tool replaces {{part_no}} with the stored value.", "Das Werkzeug ersetzt {{part_no}} durch den gespeicherten Wert.", "Writers must not leave [INSERT DATE] in it.", "Platzhalter wie {{ref}} sind verboten.", "{{ref}} is a placeholder."]
    assert [x for x in held if not has_slot(x)] == [] and [x for x in spoken if has_slot(x)] == []


def test_verdicts():
    want = {
        "Error 404 – the page you asked for was not found": "error", "Votre session a expiré, reconnectez-vous": "error", "Please enable JavaScript to view this page.": "script", "Body text placeholder.": "filler",
        "Amet velum tellum egestra pulvar sollen.": "filler", "bla bla bla bla bla bla": "filler", "Back to start": "frame", "Sealed pump": "title", EN: "content",
    }
    assert {k: verdict(k) for k in want} == want


def test_guard_words_hide_nothing():
    """Messages that the patterns match pass the words that guard them."""
    from foliary.llm import residue as m

    said = "error 404|bad gateway|fehler 500|interner serverfehler|page not found|page introuvable|la page n'existe plus|seite nicht gefunden|página no existe|pagina non trovata|it no longer exists or has|request timed out|délai expiré|zeitüberschreitung|tiempo de espera|tempo scaduto|temporarily unavailable|momentanément indisponible|derzeit nicht erreichbar|no disponible temporalmente|servizio non disponibile|session expired|session a expiré|sitzung abgelaufen|sesión caducado|sessione scaduta|access denied|no permission to|accès refusé|zugriff verweigert|acceso denegado|accesso negato|scheduled maintenance|maintenance en cours|wartungsarbeiten|mantenimiento programado|too many requests|trop de requêtes|zu viele anfragen|demasiadas peticiones|troppe richieste|something went wrong|algo salió mal|qualcosa è andato storto|une erreur est survenue|si è verificato un errore|se ha producido un error|ein fehler ist aufgetreten|slow down and retry|try again later|cannot run without"
    assert [x for x in said.split("|") if not m.ERROR.search(x) or m.ERROR_WORDS.isdisjoint(m.LETTERED.findall(x))] == []
    fill = "sample text|text goes here|replace your content|to be written|texte d'exemple|contenu à compléter|remplacez ce paragraphe|faux texte|blindtext|diesen absatz ersetzen|inhalt folgt|hier steht später|texto de relleno|sustituya este párrafo|reemplace este|contenido por|testo di esempio|sostituire questo paragrafo|contenuto da scrivere|lorem ipsum|platzhalter"
    assert [x for x in fill.split("|") if not m.FILLER.search(x) or m.FILLER_WORDS.isdisjoint(m.LETTERED.findall(x))] == []
    assert verdict(" ".join(["bla"] * 900)) == "filler"


def test_a_verdict_stands_for_its_own_template_only(spark):
    one, two = "This page was not found on the server.", "This page was not signed by the inspector."
    df = spark.createDataFrame([(1, one), (2, two), (3, "Error 404 in the log"), (4, "Error 12 in the log book of the crew was closed.")], "doc_id long, text string")
    assert {r.doc_id for r in residue_ids(df, "doc_id", "text").collect()} == {1, 3}
    tree = TemplateTree(most=2)
    assert [verdict(x) for x in ("bla bla bla.", "xxxx xxxx xxxx", "Ceci est un faux texte.", "very very well")] == ["filler", "filler", "filler", "title"]
    said = [tree.verdict(x) for x in (two, one, "Request timed out after 77 ms", "Request timed out after 9 ms", one)]
    assert said == ["content", "error", "error", "error", "error"] and template_of("Part  12 of 404") == "part 0 of 404"


def test_residue_table(spark):
    rows = [(1, "Sealed pump\nRequest timed out after 77 ms\nTrace id 3-4"), (2, f"{EN} When the server answers with error 404, the crew shall log the event. {EN}"), (3, f"{EN} The value is {{{{limit}}}} bar."), (4, None), (5, ""), (6, "ok"), (7, f"{EN}\n\nText goes here."), (8, EN), (8, EN), (9, EN * 2000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, leaf int")
    assert {r.doc_id for r in residue_ids(df, "doc_id", "text").collect()} == {1, 3, 7}
    assert without_residue(df, "doc_id", "text").count() == 7
    assert residue_ids(df.limit(0), "doc_id", "text").count() == 0
