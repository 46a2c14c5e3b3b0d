"""Defects of question and answer pairs, from clauses tagged by a conditional random field (problem 6)."""

from __future__ import annotations

import copy
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm.crf import ChainField, feature_ids
from foliary.llm.language import LANGUAGES, ByteNet, windows
from foliary.session import parts as shares

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
DEFECTS = {"refusal": "refusal", "echo": "copies_question", "foreign": "other_language", "unfinished": "truncated_answer"}
WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"(?<=[.!?…])[\"»”)\]]*\s+|(?<=:)\s*\n+|\n+")
ITEM = re.compile(r"^\s*(?:[-•*–]|\d+[.)]|\[.?\])\s+")
MEASURED = re.compile(r",\s*\d[\d.,]*\s*[^\W\d_°%·/]{0,3}[°%·/]?[^\W\d_]{1,4}$")
CODE_TOKEN = re.compile(r"[\W_]*(?:[A-Z]{1,5}(?:-[A-Z])?\d?|\d[\w.()/-]*|[A-Z]{1,4}-\d[\w-]*)[\W_]*")
MARKUP = re.compile(r"<[^>]{0,80}>|&[a-z]+;|[^\w]+|_+")
# Bare labels and words for nothing, after markup and punctuation are taken away.
NOTHING = set(
    """answer answers response reply a réponse reponse antwort respuesta risposta
    none null nil nan na n a nothing empty blank undefined unknown tbd tbc
    rien néant aucun aucune vide nichts keine leer nada ninguno ninguna vacío vacio niente nessuno nessuna vuoto
    no answer aucune réponse keine antwort sin respuesta nessuna risposta""".split()
) - {"no"}
#: Ways of declining, by language. * stands for the thing asked about.
REFUSALS = {
    "en": """I am sorry, but I cannot answer questions about *.|I'm sorry, I can't provide details of *.|Unfortunately I am unable to help with *.|Unfortunately I can't help with *.|I must decline to comment on *.
As an assistant I have no way to assess *.|As an AI assistant I am not able to give advice about *.|I'm not able to evaluate * on the basis of what I was given.|This request about * falls outside what I am allowed to answer.
No answer can be given about *, as I don't have the information.|The context provided holds nothing that would let me answer questions about *; please contact a specialist.|I do not have enough information to answer about *.|I would rather not answer this request about *.|I am not permitted to discuss *.|There is no information about * in the documents I was given, so I cannot answer.""",
    "fr": """Je suis désolé, je ne peux pas répondre au sujet de *.|Malheureusement, je ne suis pas en mesure de vous aider pour *.|Je préfère ne pas répondre à cette demande sur *.|En tant qu'assistant, il m'est impossible de traiter la question sur *.
Je ne dispose pas des informations nécessaires pour répondre sur *.|Je regrette, je ne suis pas autorisé à répondre au sujet de *.|Le contexte fourni ne me permet pas de répondre sur *.|Aucune réponse ne peut être donnée sur *, faute d'informations.|Cette demande sur * dépasse ce que j'ai le droit de traiter.""",
    "de": """Es tut mir leid, dazu kann ich keine Auskunft geben: *.|Leider kann ich Ihnen bei diesem Thema nicht helfen (*).|Als Assistent darf ich diese Frage nicht beantworten (*).|Mir liegen keine Informationen vor, um die Frage zu beantworten (*).
Ich bin leider nicht in der Lage, die Frage zu beantworten: *.|Ich möchte diese Anfrage lieber nicht beantworten (*).|Der Kontext reicht mir nicht, um dazu etwas zu sagen: *.|Diese Anfrage geht über das hinaus, was ich beantworten darf (*).""",
    "es": """Lo siento, no puedo responder sobre *.|Por desgracia no estoy en condiciones de responder acerca de *.|Como asistente no me es posible ayudar con *.|No dispongo de la información necesaria para responder sobre *.
Prefiero no responder a esta solicitud sobre *.|Lamentablemente no me está permitido contestar acerca de *.|El contexto no me permite responder sobre *.|No se puede dar una respuesta sobre *, pues me falta información.""",
    "it": """Mi dispiace, non posso rispondere su *.|Come assistente non sono in grado di aiutare con *.|Purtroppo non mi è possibile rispondere riguardo a *.|Non dispongo delle informazioni necessarie per rispondere su *.
Preferisco non rispondere a questa richiesta su *.|Purtroppo non sono autorizzato a trattare la domanda su *.|Il contesto non mi permette di rispondere su *.|Non è possibile dare una risposta su *, perché mi mancano le informazioni.""",
}
#: Courtesies that may stand before or after a refusal.
COURTESIES = {
    "en": "Thank you for the question.|That is an interesting point.|This is for safety reasons.|Please rephrase.|Please contact a specialist.",
    "fr": "Merci pour votre question.|C'est une question de sécurité.|Veuillez consulter un spécialiste.",
    "de": "Danke für die Frage.|Bitte fragen Sie das Archiv.|Bitte wenden Sie sich an eine Fachkraft.",
    "es": "Gracias por la pregunta.|Consulte a un especialista.|Es por motivos de seguridad.",
    "it": "Grazie per la domanda.|Si rivolga a uno specialista.|È per motivi di sicurezza.",
}
#: Words that introduce a repeated question.
ASKED = {"en": "Question:|You asked:|Your question was:|Re:", "fr": "Question :|Vous demandez :|Votre question :", "de": "Frage:|Sie fragen:", "es": "Pregunta:|Usted pregunta:", "it": "Domanda:|Lei chiede:"}


def says_nothing(text: str | None) -> bool:
    """Null, or nothing but white space, punctuation, markup, a bare label or a word for nothing."""
    if text is None or len(text) > 400:
        return text is None or not WORD.search(re.sub(r"<[^>]{0,80}>|&[a-z]+;", " ", text))
    return all(w in NOTHING for w in MARKUP.sub(" ", text.lower()).split())


def bare_code(clause: str) -> bool:
    """A line of nothing but a reference."""
    return len(clause) < 40 and any(map(str.isdigit, clause)) and all(map(CODE_TOKEN.fullmatch, clause.split()))


def clauses(text: str) -> list[str]:
    return [c for c in CLAUSE.split(text.strip()) if c.strip()]


_DECLINED = [frozenset(WORD.findall(x.replace("*", " ").lower())) for v in REFUSALS.values() for x in re.split(r"[|\n]", v)]


def seems_declined(clause: str) -> bool:
    """Most words of a known way of declining: only a hint for choosing training pairs."""
    mine = set(WORD.findall(clause.lower()))
    return any(len(d & mine) >= max(4, 0.55 * len(d)) for d in _DECLINED)


class Tagger:
    """The field, and the network that tells languages apart."""

    def __init__(self, net: ByteNet, field: ChainField | None = None):
        self.net, self.field = net, field or ChainField.fresh(len(TAGS))

    def languages(self, texts: list[str]) -> np.ndarray:
        """Log probabilities of the languages of texts, over all windows of each."""
        if not texts:
            return np.empty((0, len(LANGUAGES)))
        out = np.empty((len(texts), len(LANGUAGES)), dtype=np.float32)
        start = 0
        while start < len(texts):  # in bounded batches of windows
            wins, n = [], 0
            while start + len(wins) < len(texts) and n < 65_536:
                t = texts[start + len(wins)]
                wins.append(windows(" ".join(WORD.findall(t)) if len(t) < 400 else t))
                n += len(wins[-1])
            logs = self.net.log_probs(np.concatenate(wins))
            size = np.array([len(w) for w in wins])
            each = np.add.reduceat(logs, np.cumsum(size) - size, axis=0) / size[:, None] ** 0.5  # successive windows are alike, so they count as fewer
            out[start : start + len(wins)] = each - np.logaddexp.reduce(each, axis=1, keepdims=True)
            start += len(wins)
        return out

    def features(self, question: str, parts: list[str], q_lang: np.ndarray, langs: np.ndarray) -> list[np.ndarray]:
        """Feature numbers of each clause: what it shares with the question, its language and that of the answer as a whole against the
        question's, how it ends, and its words (also together with the language of the question, which tells a foreign word)."""
        asked = Counter(WORD.findall(question.lower()))
        total, home, out = max(1, sum(asked.values())), int(q_lang.argmax()), []
        whole, q_share = np.maximum(langs, -6).sum(axis=0), np.exp(2 * np.maximum(q_lang, -3))
        agrees = lambda logs: float(q_share @ np.exp(logs - np.logaddexp.reduce(logs)) / q_share.sum())
        whole_same = agrees(whole)
        each = [sum(map(str.isalpha, p)) for p in parts]
        lettered = sum(each)
        near = lambda p: "home" if p > 0.5 else "unsure" if p > 0.1 else "away" if p > 0.01 else "far"
        answered = "short" if lettered < 12 else f"{min(2, lettered // 40)}-{near(whole_same)}"
        for i, c in enumerate(parts):
            low = WORD.findall(c.lower())
            mine = Counter(low)
            common = sum(min(n, asked[w]) for w, n in mine.items())
            inside = common / max(1, len(low))
            last, item = i == len(parts) - 1, bool(ITEM.match(c))
            letters = each[i]
            tail = c.rstrip()
            if tail.endswith(("…", "..")):
                end = "dots"
            else:
                end = "stop" if tail[-1:] in ".!?" else "close" if tail[-1:] in "\"»”)]" else "colon" if tail[-1:] in ":;," else "mark" if not tail[-1:].isalnum() else "open"
            code = bare_code(tail) and not item
            measured = bool(MEASURED.search(tail))
            tongue = "short" if letters < 12 else f"{min(3, letters // 12)}-{near(agrees(langs[i]))}"
            covers = int(min(1, common / total) * 5)
            f = ["bias", f"in{int(inside * 5)}", f"covers{covers}", f"in{int(inside * 5)}&covers{covers}", f"tongue{tongue}", f"answered{answered}", f"tongue{tongue}&answered{answered}", f"item{item}", f"first{i == 0}", f"only{len(parts) == 1}"]
            f += [f"last{last}&end{end}&code{code}", f"last{last}&end{end}&item{item}&measured{measured}", f"words{min(4, len(low) // 4)}", f"asks{'?' in c}", f"alone{len(parts) == 1}&in{int(inside * 5)}"]
            if not last:
                f += ["inner"]
            else:
                if end == "open" and not code and not (item and measured):
                    f += ["hangs"]
                shape = re.sub(r"\d+", "#", " ".join(tail.split()[-2:]))
                f += [f"code{code}&end{end}", f"ends{item}&{shape.split(' ')[-1] if item else shape if re.search('[A-Z]', shape) else ''}"]
            plain = [w for w in low if w.isalpha() and w not in asked]
            f += [f"w={w}" for w in set(plain)] + [f"{home}:{w}" for w in set(plain)] + [f"b={a} {b}" for a, b in zip(plain, plain[1:])]
            out.append(feature_ids(f))
        return out

    def teach(self, pairs: list[tuple[str, str]], seed: int = 11, rounds: int = 3) -> Tagger:
        """Fit on clauses made from sound pairs: kept, cut short, replaced by the question, by declining, or by another pair's answer.

        A first fit tags the given pairs themselves; those it finds defective are left out of the second.
        """
        r = random.Random(seed)
        self.adapt(pairs)
        for turn in range(2):
            self.field = ChainField.fresh(len(TAGS))
            made = self._examples(pairs if turn else pairs[::2], r)
            langs = self.languages([x for _, parts, _ in made for x in parts])
            q_langs = self.languages([q for q, _, _ in made])
            data, at = [], 0
            for (q, parts, tags), ql in zip(made, q_langs):
                data.append((self.features(q, parts, ql, langs[at : at + len(parts)]), tags))
                at += len(parts)
            self.field.fit(data, rounds=rounds)
            if turn == 0:
                found = self.judge(pairs)
                pairs = [p for p, d in zip(pairs, found) if d is None] or pairs
        return self

    def adapt(self, pairs: list[tuple[str, str]], steps: int = 300) -> None:
        """Fit the network further to these texts. Nearly all answers are in the question's language, so what both sides together say is a
        label for each; pairs whose sides contradict one another teach nothing."""
        given = [(q, a) for q, a in pairs if q.strip() and not says_nothing(a)]
        if len(given) < 50:
            return
        q, a = self.languages([x for x, _ in given]), self.languages([x for _, x in given])
        both = np.maximum(q, -6) + np.maximum(a, -6)
        both -= np.logaddexp.reduce(both, axis=1, keepdims=True)
        lang, rows = both.argmax(axis=1), np.arange(len(both))
        good = (both[rows, lang] > np.log(0.7)) & (np.minimum(q, a)[rows, lang] > np.log(0.02))
        seen, kept = np.bincount(lang, minlength=len(LANGUAGES)), np.bincount(lang[good], minlength=len(LANGUAGES))
        if any(3 * k < n for n, k in zip(seen, kept) if n >= 0.02 * len(given)):  # a language of these texts would be unlearnt
            return
        good = np.flatnonzero(good)
        wins = [(windows(" ".join(WORD.findall(t)) if len(t) < 400 else t)[:3], lang[i]) for i in good for t in (*given[i], given[i][1][:60])]
        if wins:
            x, y = np.concatenate([w for w, _ in wins]), np.concatenate([np.full(len(w), k) for w, k in wins])
            self.net = copy.deepcopy(self.net).fit(x, y, rounds=max(1, round(steps * 64 / len(y))), rate=2e-3)

    def _examples(self, pairs, r) -> list[tuple[str, list[str], list[int]]]:
        a, ref, ech, fo, un = range(5)
        langs = [LANGUAGES[int(x.argmax())] for x in self.languages([q for q, _ in pairs])]
        tongues = self.languages([x for _, x in pairs])
        out = []
        for n, ((q, answer), lang) in enumerate(zip(pairs, langs)):
            parts = clauses(answer)
            if not parts or says_nothing(answer):
                continue
            if any(map(seems_declined, parts)):
                if len(answer) < 250:
                    out.append((q, parts, [ref] * len(parts)))
                continue
            said, asked = Counter(WORD.findall(answer.lower())), Counter(WORD.findall(q.lower()))
            if sum((said & asked).values()) > 0.85 * sum(said.values()) and sum(said.values()) > 4:
                out.append((q, parts, [ech] * len(parts)))
                continue
            if len(answer) > 30 and tongues[n][LANGUAGES.index(lang)] < np.log(0.02):
                if answer.rstrip()[-1:] in ".!?":
                    out.append((q, parts, [fo] * len(parts)))
                continue
            coded = len(parts) > 1 and parts[-2].rstrip()[-1:] in ".!?»" and bare_code(parts[-1])
            whole = answer.rstrip()[-1:] in ".!?»" and answer.rstrip()[-2:] != ".." or bool(ITEM.match(parts[-1]) and MEASURED.search(parts[-1].rstrip())) or bool(coded)
            if whole:
                out.append((q, parts, [a] * len(parts)))
                short = parts[: r.randint(1, len(parts))]
                if len(short) < len(parts) and r.random() < 0.3 and short[-1].rstrip()[-1:] in ".!?":  # an answer that ends earlier, at a sentence's end, is whole
                    out.append((q, short, [a] * len(short)))
            kind = r.random()
            if kind < 0.3 and whole and len(answer) > 30:
                at = r.randint(12, len(answer) - 2)
                cut, beyond = answer[:at], answer[at]
                bits = clauses(cut)
                inside = beyond.isalnum() if cut.rstrip()[-1:] in ".!?" else beyond not in "\n\r" and not cut.endswith("\n")  # within a word, number, sentence or item
                if bits and inside and not bare_code(bits[-1]) and len(bits[-1].strip()) > 2:
                    dots = r.choice(["…", "...", " …", " ..."]) if r.random() < 0.2 else ""
                    out.append((q, [*bits[:-1], bits[-1].rstrip() + dots] if dots else bits, [a] * (len(bits) - 1) + [un]))
            elif kind < 0.5:
                word = r.choice(ASKED[lang].split("|")) + " "
                said = q.split()
                if r.random() < 0.4 and len(said) > 4:
                    said.pop(r.randrange(len(said))) if r.random() < 0.5 else said.insert(r.randrange(len(said)), r.choice(answer.split() or ["x"]))
                text = " ".join(said)
                text = r.choice([text, text, word + text, f"{text} {text}", f"« {text} »", text.rstrip("? ") + ".", text.upper()])
                bits = clauses(text)
                out.append((q, bits, [ech] * len(bits)))
                if whole:
                    out.append((q, bits + parts, [ech] * len(bits) + [a] * len(parts)))
            elif kind < 0.75:
                thing = " ".join(q.rstrip("? .").split()[-r.randint(2, 5) :])
                text = r.choice(re.split(r"[|\n]", REFUSALS[lang if r.random() < 0.95 else "en"])).replace("*", thing)
                if r.random() < 0.3:
                    text = r.choice(COURTESIES[lang].split("|")) + " " + text
                if r.random() < 0.3:
                    text += " " + r.choice(COURTESIES[lang].split("|"))
                bits = clauses(text)
                out.append((q, bits, [ref] * len(bits)))
            else:
                j = r.randrange(len(pairs))
                other = clauses(pairs[j][1])
                if langs[j] != lang and other and pairs[j][1].rstrip()[-1:] in ".!?" and len(pairs[j][1]) > 30:
                    out.append((q, other, [fo] * len(other)))
        return out

    def judge(self, pairs: list[tuple[str, str]]) -> list[str | None]:
        """The defect of each pair with a non-empty answer, or None."""
        split = [clauses(a) for _, a in pairs]
        langs = self.languages([c for parts in split for c in parts])
        q_langs = self.languages([q for q, _ in pairs])
        out, at = [], 0
        for (q, _), parts, ql in zip(pairs, split, q_langs):
            if not parts:
                out.append(None)
                continue
            tags = [TAGS[t] for t in self.field.best(self.features(q, parts, ql, langs[at : at + len(parts)]))]
            at += len(parts)
            size = Counter()
            for c, t in zip(parts, tags):
                size[t] += len(c)
            whole = sum(size.values())
            if size["refusal"] and size["refusal"] >= 0.5 * whole:
                out.append(DEFECTS["refusal"])
            elif size["echo"] >= 0.8 * whole and _repeats(q, parts):
                out.append(DEFECTS["echo"])
            elif size["foreign"] and size["foreign"] >= 0.6 * whole:
                out.append(DEFECTS["foreign"])
            elif tags[-1] == "unfinished":
                out.append(DEFECTS["unfinished"])
            else:
                out.append(None)
        return out


def _repeats(question: str, parts: list[str]) -> bool:
    """Half of the question's words come back."""
    asked, said = Counter(WORD.findall(question.lower())), Counter(WORD.findall(" ".join(parts).lower()))
    return 2 * sum((asked & said).values()) >= max(1, sum(asked.values()))


def sample_pairs(df: DataFrame, question: str, answers: list[str], most: int) -> list[tuple[str, str]]:
    """At most `most` different pairs with both sides given, of all answer columns: the bounded training sample. Pairs are drawn by their
    hash and put in its order, so the sample follows from the rows alone, however they are parted."""
    pair = F.explode(F.array(*[F.struct(F.col(question).alias("q"), F.col(a).alias("a")) for a in answers]))
    rows = df.select(pair.alias("p")).select("p.q", "p.a").where("q is not null and a is not null").withColumn("h", F.xxhash64("q", "a"))
    share = int(1_000_000 * min(1.0, 1.1 * most / max(rows.count(), 1)))
    drawn = rows.where(F.pmod("h", F.lit(1_000_000)) < share).distinct().toArrow()
    found = sorted(zip(*(drawn[c].to_pylist() for c in ("h", "q", "a"))))[:most]
    return [(q, a) for _, q, a in found]


def defective_pairs(df: DataFrame, id_col: str, question: str, answers: list[str], tagger: Tagger, required: tuple[str, ...] = ()) -> DataFrame:
    """id_col, answer_field, defect of every defective pair of the question with one of the answer columns; at most one defect each.

    A blank answer is a defect only in the `required` columns. A null question is taken as empty; null ids are kept; rows repeated with
    the same id, question and answers count once; an empty table gives an empty table; other columns are not read. Whole answers are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, asked = b.column(0).to_pylist(), [q or "" for q in b.column(1).to_pylist()]
            rows = []
            for k, name in enumerate(answers):
                given = b.column(2 + k).to_pylist()
                blank = [says_nothing(a) for a in given]
                if name in required:
                    rows += [(i, name, "empty_answer") for i, e in zip(ids, blank) if e]
                at = [j for j, e in enumerate(blank) if not e]
                found = tagger.judge([(asked[j], given[j]) for j in at])
                rows += [(ids[j], name, d) for j, d in zip(at, found) if d]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["id", "answer_field", "defect"])

    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(question).alias("q"), *[F.col(a).alias(f"a{k}") for k, a in enumerate(answers)]).distinct()
    return src.repartition(shares(df.sparkSession)).mapInArrow(run, "id string, answer_field string, defect string").withColumnRenamed("id", id_col).distinct()
