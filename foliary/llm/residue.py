"""Template residue and error pages among texts, by mined message templates and unresolved slots (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.session import spread

MESSAGE = re.compile(r"(?<=[.!?])\s+|[\r\n]+")
NUMBER = re.compile(r"\d+")
LETTERED = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
DEPTH = 4

# Short function words of the five languages; a sentence of prose has some of them.
FUNCTION_WORDS = frozenset(
    """a an the and or of to in on at by for with from is are was were be been not no it its this that these when if as may must shall has have which who how what do does all any each under after before
    le la les un une des du de et ou à au aux en sur par pour avec est sont a été ne pas que qui il elle ce cet cette dans si plus son sa ses chaque tout l d n s c qu
    der die das den dem des ein eine einen einem einer und oder von zu zum zur im in am an auf aus bei mit nach für ist sind wird wurde werden nicht kein keine wie wenn als bis dass es er sie sich alle
    el los las una uno y o del al en con por para es son fue se su sus no que como cuando si más cada lo sin este esta
    il lo gli i uno e ed di del della dello dei delle da dal dalla nel nella su sul con per è sono non che si come quando se più ogni questo questa""".split()
)
# What messages of failed pages, of missing scripts and of unwritten text say, in the five languages, lower-cased.
ERROR = re.compile(
    "|".join((
    r"""\b(?:http )?(?:error|erreur|fehler|errore) (?:http )?[45]\d\d\b|^[45]\d\d\b|\bbad gateway\b|\bgateway time-?out\b|\binternal server error\b|\berreur interne\b|\binterner (?:server)?fehler\b|\berror interno\b|\berrore interno\b""",
    r"""\b(?:page|file|document|resource)\b.*\bnot (?:be )?found\b|\bpage\b.*\b(?:introuvable|n'existe plus)|\bseite\b.*\b(?:nicht gefunden|existiert nicht)|\bpágina\b.*\b(?:no encontrada|no existe)|\bpagina\b.*\b(?:non trovata|non esiste)|\bno longer exists or has\b""",
    r"""\btimed out\b|\bdélai\b.*\b(?:dépassé|expiré)\b|\bzeitüberschreitung\b|\btiempo de espera\b|\btempo scaduto\b|\btemporarily unavailable\b|\bmomentanément indisponible\b|\b(?:derzeit|momentan|vorübergehend) nicht (?:erreichbar|verfügbar)\b|\bno (?:está )?disponible (?:temporalmente|en este momento)\b|\btemporalmente no disponible\b|\bservicio no disponible\b|\bservizio (?:al momento |momentaneamente )?non (?:è )?(?:al momento )?(?:disponibile|raggiungibile)\b|\bmomentaneamente non disponibile\b|\btemporaneamente non disponibile\b""",
    r"""\bsession\b.*\bexpired?\b|\bsession a expiré\b|\bsitzung\b.*\babgelaufen\b|\bsesión\b.*\b(?:caducado|expirado)\b|\bsessione\b.*\bscaduta\b|^access (?:is )?denied\W*$|\bno permission to\b|^accès refusé\b|^zugriff verweigert\b|^acceso denegado\b|^accesso negato\b""",
    r"""\bscheduled maintenance\b|\bmaintenance (?:programmée|en cours)\b|\bwartungsarbeiten\b|\bmantenimiento programado\b|\bmanutenzione programmata\b|\btoo many requests\b|\btrop de requêtes\b|\bzu viele anfragen\b|\bdemasiadas (?:peticiones|solicitudes)\b|\btroppe richieste\b|\b(?:something|etwas) (?:went wrong|ist schiefgelaufen)\b|\balgo salió mal\b|\bqualcosa è andato storto\b|\bune erreur est survenue\b|\bsi è verificato un errore\b|\bse ha producido un error\b|\bein fehler ist aufgetreten\b|\bslow down and retry\b|\btry again (?:later|in a few)\b|\bcannot (?:start|run|load) without\b""",
    ))
)
# Words of which a message has one wherever ERROR can match (those that begin with a status code apart).
ERROR_WORDS = frozenset(
    """error erreur fehler errore gateway interner found introuvable existe gefunden existiert encontrada trovata esiste exists timed délai zeitüberschreitung
    espera scaduto unavailable indisponible erreichbar verfügbar disponible disponibile raggiungibile expire expired expiré abgelaufen caducado expirado scaduta
    denied permission refusé verweigert denegado negato maintenance wartungsarbeiten mantenimiento manutenzione requests requêtes anfragen peticiones solicitudes
    richieste wrong schiefgelaufen mal storto survenue verificato producido aufgetreten retry again without serverfehler""".split()
)
SCRIPT = re.compile(r"\b(?:java ?scripts?|scripts?|scripting|skripte?n?)\b")
SCRIPT_WANTED = re.compile(
    r"""\b(?:enable|activate|turn (?:them|it)? ?on|switch on|disabled|need(?:s|ed)?|require[sd]?|without|cannot|active[rz]?|activez|désactivée?|sans|aktivieren|aktiviert|deaktiviert|ohne|benötigt|erforderlich|activar?|habilite|desactivado|necesita|requiere|sin|attiva(?:re)?|abilita(?:re)?|attivi|disattivato|disabilitato|senza|richiede|serve)\b"""
)
FILLER = re.compile(
    "|".join((
    r"""\bplaceholder\b|\b(?:sample|dummy|filler) (?:text|content)\b|\btext goes here\b|\b(?:replace|insert|overwrite) (?:this|your) (?:paragraph|text|content)\b|\bto be written\b|\btexte d.exemple\b|\bcontenu à (?:rédiger|compléter|venir)\b|\bremplace[rz] ce (?:paragraphe|texte)\b|\b(?:faux[- ]texte|texte (?:ici|factice|provisoire|de remplissage))\b""",
    r"""\b(?:beispiel|platzhalter|muster|füll|blind)text\b|\bplatzhalter\b|\b(?:diesen|dieser) (?:absatz|text)\b.*\b(?:ersetzen|ersetzt)|\b(?:inhalt|text) folgt\b|\bhier steht (?:später|dann)\b|\btext hier\b|\btexto de (?:ejemplo|relleno|muestra)\b|\bsustituya este (?:párrafo|texto)\b|\breemplace este\b|\bcontenido (?:por|pendiente)\b|\btesto (?:di esempio|segnaposto|qui)\b|\bsostituire questo (?:paragrafo|testo)\b|\bcontenuto da (?:scrivere|inserire|redigere)\b|\blorem ipsum\b""",
    ))
)
# Words of which a message has one wherever FILLER can match.
FILLER_WORDS = frozenset(
    """placeholder text content paragraph written texte contenu paragraphe beispieltext platzhaltertext mustertext fülltext blindtext platzhalter absatz inhalt hier
    texto párrafo reemplace contenido testo paragrafo contenuto lorem""".split()
)
FRAME = re.compile(r"^(?:error|erreur|fehler|errore|warning|!+|loading\W*|chargement\W*|cargando\W*|caricamento\W*|(?:trace|request id|ref|reference|code|id)\b[ :#].*|back to \w+|retour\b.{0,20}|zurück\b.{0,20}|volver\b.{0,20}|torna\b.{0,20}|at [\w.$<>]+\(.*\)|[^›»>]{1,30}[›>] .{1,60}|<[^>]*>)$")
# Fixed values, in the five languages: how a sentence speaks of a slot instead of holding it. The words govern the slot: they stand directly before it
# (a noun for marks, a verb of leaving whose subject is who writes, a verb of replacing with a value for its second object) or after it (a noun for marks only).
_NOUN = r"(?:marks?|markers?|placeholders?|marques?|marken?|markierung(?:en)?|platzhaltern?|marcas?|marcador(?:es)?|marchi|marcatur[ae]|segn[ai]posto)"
_FIELD = r"(?:(?:the|a|any|le|les|un|des|das|die|dem|ein|kein|el|los|il|i)\s+(?:fields?|champs?|feld(?:er)?|campos?|campo|campi))"
_LIKE = r"(?:such as|like|called|named|comme|tel(?:le)?s? que|wie|namens|como|tales como|come|quali)"
GOVERNED = re.compile(
    rf"""(?ix)(?:\b(?:{_NOUN}|{_FIELD})(?:,?\s+{_LIKE.replace(" ", chr(92) + "s")})?
    |\b(?:writers?|authors?|editors?|rédact\w+|auteurs?|verfasser\w*|autor\w*|redakt\w+|redact\w+|redatt\w+)\b[^,;:]{{0,40}}\s(?:leave|leaves|laiss\w+|lassen|lässt|dej\w+|lasci\w+))\s*[:(]?\s*["'“„«]?\s*$"""
)
REPLACED = re.compile(r"(?i)\b(?:replaces?|remplacent?|ersetzt|ersetzen|sustituyen?|reemplazan?|sostituisc(?:e|ono))\s*[\"'“„«]?\s*$")
VALUE_AFTER = re.compile(r"(?i)^[\"'”“»]?\s*(?:with|by|par|durch|por|con)\s+(?:the|its|a|la|sa|une|den|einen|el|su|un|il)?\s*(?:\w+\s+)?(?:values?|valeurs?|werte?s?|valor(?:es)?|valor[ei])\b")
MARK_AFTER = re.compile(r"(?i)^[\"'”“»]?\s*(?:(?:is|are|est|ist|es|è)\s+(?:(?:only|just)\s+)?(?:a|an|un|une|ein)\s+)?(?:placeholders?|platzhalter|segn[ai]posto)\b")
AND = re.compile(r"(?i)\s*(?:,|\b(?:or|and|ou|et|oder|und|o|y|e)\b)\s*")
SLOT = re.compile(
    r"""(?=[{<$\#\[«@_%&XTF])(?:\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|<%[^<>\n]{1,60}%>|[$\#]\{[^{}\n]{1,60}\}|\{[A-Za-z][\w.]{1,40}\}|\[\[[^\[\]\n]{1,60}\]\]|<<[^<>\n]{1,60}>>|«[\w.]{2,40}»|@@[^@\s]{1,40}@@|\$\$[^$\s]{1,40}\$\$|(?<![^\W_])__[^\W_][\w.]{0,40}?__(?![^\W_])|%[^\W\d_][\w.]{1,40}%
    |<[A-Z][A-Z_ ]{1,40}>|<[a-z]+_[a-z_]+>|&lt;[^&<>\n]{1,40}&gt;|\bXX/XX/X{2,4}\b|\[(?:[A-ZÀ-Ü]{2,}|[ÀÉ])(?:[ :]+[A-ZÀ-Ü]{2,})+\]|\[(?:your|votre|ihre?|su|il tuo)\b[^\[\]\n]{1,40}\]|\[(?:insert|enter|add|fill in|saisir|insérer|compléter|einfügen|eintragen|insertar|rellenar|inserire)\b[^\[\]\n]{0,40}\]|(?<!_)_{5,}(?!_)|\b(?:TBD|TBC|TODO|FIXME)\b)""",
    re.X,
)
#: The same places, loosely, for the engine to see which texts need the search at all.
MAYBE_SLOT = r"[{}\[<«@$%]|&lt;|__|XX/|TB[DC]|TODO|FIXME"


def template_of(message: str) -> str:
    """The template of a message: lower-cased, spacing made even, its numbers replaced by 0 (but for those that may be status codes)."""
    low = " ".join(message.lower().split())
    return NUMBER.sub(lambda m: m[0] if len(m[0]) == 3 and m[0][0] in "45" else "0", low) if DIGIT.search(low) else low


class TemplateTree:
    """Templates mined from messages, in a prefix tree of fixed depth: the length class, the first DEPTH tokens, then the templates of the
    leaf, told apart by all their tokens. Each is classified once, when it is first met, by itself alone; so the verdict on a message never
    depends on what else the tree holds, on the order of the rows or on how they are parted."""

    def __init__(self, most: int = 300_000):
        self.root: dict = {}
        self.size, self.most = 0, most

    def verdict(self, message: str) -> str:
        found = template_of(message)
        tokens = found.split(" ", DEPTH)
        n = len(found) // 6
        node = self.root.setdefault(n if n <= 12 else 12 + n // 8, {})
        for t in tokens[:DEPTH]:
            node = node.setdefault(t, {})
        leaf = node.setdefault(None, {})
        out = leaf.get(found)
        if out is None:
            if self.size >= self.most:  # later messages only make their templates anew
                self.root, self.size, leaf = {}, 0, {}
            out = leaf[found] = _verdict(found)
            self.size += 1
        return out


def has_slot(text: str) -> bool:
    """An unresolved slot where a value belongs, not one that the sentence speaks of or quotes as code."""
    spoken = -1  # end of the last slot spoken of
    for m in SLOT.finditer(text):
        a, b = m.span()
        if text[a - 1 : a] == "`" or text[b : b + 1] == "`":
            continue
        start = max(text.rfind(c, max(0, a - 300), a) for c in ".\n!?") + 1
        before, after = text[max(start, a - 300) : a], text[b : b + 60]
        if (spoken >= 0 and AND.fullmatch(text, spoken, a)) or GOVERNED.search(before) or (REPLACED.search(before) and VALUE_AFTER.search(after)) or MARK_AFTER.search(after):
            spoken = b
            continue
        return True
    return False


def verdict(message: str) -> str:
    """What a message (standing for its template) is: error, script, filler, frame, title, or content."""
    return _verdict(" ".join(message.lower().split()))


def _verdict(low: str) -> str:
    """verdict() of a message in lower case with even spacing."""
    script = False
    if "noscript>" in low:
        script = "<noscript>" in low
        low = " ".join(re.sub(r"</?noscript>", " ", low).split())
    if low[:1] == "!" or low.startswith("loading"):
        low = re.sub(r"^(?:!+|loading…?)\s+", "", low)
    ws = LETTERED.findall(low)
    n = len(ws)
    if script or n <= 20 and ("script" in low or "skript" in low) and SCRIPT.search(low) and SCRIPT_WANTED.search(low):
        return "script"
    if n <= 9 and not FILLER_WORDS.isdisjoint(ws) and FILLER.search(low):
        return "filler"
    if n <= 20 and (low[:1] in ("4", "5") or not ERROR_WORDS.isdisjoint(ws)) and ERROR.search(low):
        return "error"
    if FRAME.match(low):
        return "frame"
    if n >= 4 and low[-1:] in ".!?" and FUNCTION_WORDS.isdisjoint(ws) and not DIGIT.search(low):
        return "filler"
    kinds = len(set(ws))
    if n >= 6 and kinds <= 3 or n >= 3 and kinds == 1 or n >= 2 and all(len(w) >= 3 and len(set(w)) == 1 for w in ws):
        return "filler"
    if not ws:
        return "filler" if len(low) >= 4 and len(set(low)) == 1 and low[0] not in "-=*#_~|+" else "frame"
    if len(low) < 80 and low[-1:] not in ".!?:;" and "|" not in low:
        return "title"
    return "content"


def weighed(df: DataFrame, id_col: str, text_col: str, least_chars: int = 10) -> DataFrame:
    """id, slot (an unresolved slot), bad, filler, content: characters of each text's messages (lines and sentences) by the verdicts on their templates.

    Each task grows a tree of templates as it reads and gives a template's verdict to all its messages, so no table of messages or
    verdicts leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree()
        for b in batches:
            slots, sums = [], np.zeros((b.num_rows, 3), np.int64)
            for i, (t, maybe) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                slots.append(bool(maybe) and has_slot(t))
                for p in MESSAGE.split(t):
                    if not p or p.isspace():
                        continue
                    what = tree.verdict(p)
                    if what == "content":
                        sums[i, 2] += len(p)
                    elif what in ("error", "script", "filler"):
                        sums[i, 0] += len(p)
                        sums[i, 1] += len(p) * (what == "filler")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.bool_()), *(pa.array(sums[:, c]) for c in range(3))], names=["id", "slot", "bad", "filler", "content"])

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") >= least_chars)
    return spread(src).select("id", "text", F.col("text").rlike(MAYBE_SLOT).alias("maybe")).mapInArrow(run, "id long, slot boolean, bad long, filler long, content long")


def residue_ids(df: DataFrame, id_col: str, text_col: str, least_chars: int = 10, most_content: float = 1.0) -> DataFrame:
    """id of every text that is residue, or has an unresolved slot or a filler paragraph in a place for content.

    A text is residue if messages judged error, script or filler outweigh its content (titles and page furniture count for nothing).
    Null texts and texts under least_chars are never residue; repeated rows count once; null ids are left out; an empty table gives an
    empty table; texts are read whole; other columns are not read. Of rows that share an id but not the text, one that is residue is enough.
    """
    found = weighed(df.where(F.col(id_col).isNotNull()), id_col, text_col, least_chars)
    bad = F.col("slot") | ((F.col("bad") > 0) & (F.col("content") <= F.col("bad") * most_content)) | (F.col("filler") > 0)
    return found.where(bad).select("id").distinct().withColumnRenamed("id", id_col)


def without_residue(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df whose text is no residue; rows with null ids or texts stay."""
    return df.join(residue_ids(df, id_col, text_col), id_col, "left_anti").select(df.columns)
