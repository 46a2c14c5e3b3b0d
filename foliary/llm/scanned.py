"""Repairing the text of scanned pages with a trained character editor and page-position features (problem 2)."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.session import materialize, parts, spread

MARKS = "-‐‑­¬"
#: Letters, with the signs that stand for letters in misread words.
WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*(?:[@|$€][^\W_]*)*|[@|$€]+[^\W\d_][^\W_]*")
COMPOUND = re.compile(r"[^\W_@|]+(?:[@|][^\W_]*)*(?:-[^\W_]+)*")
CODE = re.compile(r"^(?:[A-Z]{1,4}\d{0,2}|[IVXLC]+|[a-z]?\d+[a-z]?)$")
ROMAN = re.compile(r"^(?=[ivxlc])(x{0,3})(ix|iv|v?i{0,3})$")
NUMBER_LINE = re.compile(r"^\W*(?:[^\W\d_]{1,6}(?:\.\s*|\s+)\W*)?(\d{1,4}|[ivxlcIVXLC]{1,6})(?:\s*(?:/|of|von|sur|de|di|-|–)\s*\d{1,4})?\W*$")
# Words that may stand before a page's number.
PAGE_WORDS = frozenset("page seite pagina página pag pg p s folio blatt feuille hoja foglio".split())
# Shapes that scanning takes for one another in either direction, besides single letters.
SHAPES = (("cl", "d"), ("ii", "u"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("li", "h"), ("vv", "w"), ("ri", "n"), ("tl", "d"), ("nn", "m"), ("ni", "m"), ("d", "cl"), ("u", "ii"), ("h", "li"), ("w", "vv"), ("n", "ri"))
SIGNS = "@|$€0123456789"
ZONE = 3
LEAST_KEY = 7  # characters of a running head
LEAST_WORD, LEAST_COMPOUND = 5, 3  # occurrences that make a word, or a hyphenated compound, one of the lexicon, whatever the size of the collection


def head_key(line: str) -> str:
    """A line as it repeats from page to page: numbers, case and spacing taken away."""
    return " ".join(re.sub(r"[\dlI|O]*\d[\dlI|O]*", "#", line.replace("@", "a").replace("|", "l")).lower().split()).rstrip("# ")


def close(a: str, b: str, share: float = 0.12) -> bool:
    """Two keys that differ in few characters (misreadings): edit distance within a share of the length."""
    if a == b:
        return True
    most = max(2, int(share * max(len(a), len(b))))
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 6:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def zones(lines: list[str]) -> tuple[list[int], list[int]]:
    """Numbers of the first and the last lines of a page that are not blank."""
    full = [i for i, s in enumerate(lines) if s.strip()]
    return full[:ZONE], full[-ZONE:]


def page_values(line: str) -> list[int]:
    """The numbers a line may show if it holds nothing but a page's number, in any dress; digits may be misread as letters."""
    s = line.strip()
    if not s or len(s) > 24:
        return []
    out = []
    for t in dict.fromkeys((s, re.sub(r"(?<![^\W\d_])[\dlIO|o]+(?![^\W\d_])", lambda m: m[0].translate(str.maketrans("lI|Oo", "11100")), s))):
        m = NUMBER_LINE.match(t)
        if not m:
            continue
        word = re.match(r"\W*([^\W\d_]+)\.?\s+\W*(?=[\divxlcIVXLC])", t)
        if word and word[1].lower() not in PAGE_WORDS and not any(close(word[1].lower() + "____", p + "____", 0.1) for p in PAGE_WORDS if len(p) > 3):
            continue
        n = m[1].lower()
        if n.isdigit():
            out.append(int(n))
        elif r := ROMAN.match(n):
            units = {"": 0, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9}
            out.append(10 * len(r[1]) + units[r[2]])
    return out


@dataclass
class Editor:
    """An averaged perceptron that names, for each character of a word, what to do: keep, del, rep:string, or ins:string (keep the character and
    insert the string behind it); and for the mark at the end of a line whether to join the lines there or keep the mark."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    @staticmethod
    def features(word: str, i: int, done: str) -> list[str]:
        w = f"^^{word}$$"
        j = i + 2
        a, b, c, d, e = w[j - 2], w[j - 1], w[j], w[j + 1], w[j + 2]
        f = w[j + 3] if j + 3 < len(w) else "$"
        t = f"^^{done}"[-2:]
        return ["0" + c, "1" + b + c, "2" + c + d, "3" + b + c + d, "4" + a + b + c, "5" + c + d + e, "6" + a + b + c + d, "7" + b + c + d + e, "8" + t + c + d, "9" + t + c + d + e, "a" + c + d + e + f, "b" + a + b + c + d + e]

    def choose(self, feats: list[str]) -> str:
        score: dict[str, float] = defaultdict(float)
        score["keep"] = 0.0
        for f in feats:
            for op, w in self.weights.get(f, {}).items():
                score[op] += w
        return max(score, key=lambda k: (score[k], k == "keep", k))

    def edit(self, word: str) -> list[str]:
        """One operation for each character."""
        ops, done = [], ""
        for i, ch in enumerate(word):
            op = self.choose(self.features(word, i, done))
            ops.append(op)
            done += edited(ch, op)
        return ops

    @staticmethod
    def join_features(left: str, right: str, known_left: bool, known_right: bool, starts: bool, ends: bool) -> list[str]:
        """Features of a mark between two parts of what may be one word, neither whole being in the lexicon: the characters beside it, whether
        the parts are words, and whether words start and end as they do."""
        a, b = left.lower(), right.lower()
        words, sizes = f"{known_left:d}{known_right:d}", f"{min(4, len(a))}{min(4, len(b))}"
        return ["J", f"Jw{words}", f"Jw{words}s{sizes}", f"Js{starts:d}{ends:d}", f"Js{starts:d}{ends:d}w{words}", f"Ja{a[-3:]}", f"Jb{b[:3]}", f"Jc{a[-1:]}{b[:1]}", f"Jd{a[-2:]}{b[:2]}"]

    def joins(self, feats: list[str]) -> bool:
        return sum(self.weights.get(f, {}).get("join", 0.0) for f in feats) > 0

    def fit_joins(self, examples: list[tuple[list[str], bool]], rounds: int = 4, seed: int = 4) -> Editor:
        w: dict[str, float] = defaultdict(float)
        total: dict[str, float] = defaultdict(float)
        r, step = random.Random(seed), 0
        for _ in range(rounds):
            r.shuffle(examples)
            for feats, right in examples:
                step += 1
                if (sum(w[f] for f in feats) > 0) != right:
                    for f in feats:
                        w[f] += 1.0 if right else -1.0
                        total[f] += step * (1.0 if right else -1.0)
        for f, v in w.items():
            self.weights.setdefault(f, {})["join"] = round(v - total[f] / max(step, 1), 4)
        return self

    def fit(self, pairs: list[tuple[str, list[str]]], rounds: int = 4, seed: int = 2) -> Editor:
        w: dict[tuple[str, str], float] = defaultdict(float)
        total: dict[tuple[str, str], float] = defaultdict(float)
        since: dict[tuple[str, str], int] = defaultdict(int)
        live, r, step = self.weights, random.Random(seed), 0
        for _ in range(rounds):
            r.shuffle(pairs)
            for word, ops in pairs:
                done = ""
                for i, (ch, right) in enumerate(zip(word, ops)):
                    step += 1
                    feats = self.features(word, i, done)
                    guess = self.choose(feats)
                    if guess != right:
                        for f in feats:
                            for op, d in ((right, 1.0), (guess, -1.0)):
                                k = (f, op)
                                total[k] += (step - since[k]) * w[k]
                                since[k] = step
                                w[k] += d
                                live.setdefault(f, {})[op] = w[k]
                    done += edited(ch, right)
        mean: dict[str, dict[str, float]] = {}
        for (f, op), v in w.items():
            value = (total[f, op] + (step - since[f, op]) * v) / max(step, 1)
            if value:
                mean.setdefault(f, {})[op] = round(value, 3)
        self.weights = mean
        return self


def edited(ch: str, op: str) -> str:
    """What an operation makes of a character."""
    return ch if op == "keep" else "" if op == "del" else ch + op[4:] if op.startswith("ins:") else op[4:]


def apply_edits(word: str, ops: list[str]) -> str:
    return "".join(map(edited, word, ops))


def edits_of(bad: str, good: str, at: int, seen: str, meant: str) -> list[str]:
    """Operations that turn bad into good, where `seen` at position `at` stands for `meant`; nothing seen: `meant` is missing before `at`."""
    ops = ["keep"] * len(bad)
    if not seen:
        ops[at - 1] = f"ins:{meant}"
        return ops
    ops[at] = f"rep:{meant}"
    for k in range(1, len(seen)):
        ops[at + k] = "del"
    return ops


def neighbours(word: str, alphabet: str) -> Iterator[tuple[str, int, str, str]]:
    """(other word, place, seen, meant) of every word one misreading away."""
    for i, c in enumerate(word):
        for x in alphabet:
            if x != c:
                yield word[:i] + x + word[i + 1 :], i, c, x
    for seen, meant in SHAPES:
        i = word.find(seen)
        while i >= 0:
            yield word[:i] + meant + word[i + len(seen) :], i, seen, meant
            i = word.find(seen, i + 1)


@dataclass
class Reader:
    """The editor with the lexicon it was trained on: common words, and their counts."""

    counts: dict[str, int]
    editor: Editor
    repaired: dict[str, tuple[str, list[str]] | None] = field(default_factory=dict)

    def __getstate__(self):  # what follows from the lexicon is made again where it is needed
        return {"counts": self.counts, "editor": self.editor, "repaired": {}}

    @cached_property
    def heads(self) -> frozenset[str]:
        return frozenset(w[:k] for w in self.counts if "-" not in w for k in range(1, len(w)))

    @cached_property
    def tails(self) -> frozenset[str]:
        return frozenset(w[k:] for w in self.counts if "-" not in w for k in range(1, len(w)))

    def join_features(self, a: str, b: str) -> list[str]:
        return Editor.join_features(a, b, self.known(a), self.known(b), a in self.heads, b in self.tails)

    @classmethod
    def teach(cls, counts: dict[str, int], share: float = 0.04, most_pairs: int = 40_000, seed: int = 9) -> Reader:
        """Fit on the words of the pages themselves.

        A rare word one misreading away from a far more common one (a character or two taken for others, or one lost) gives a confusion of
        characters; the confusions that recur are then laid over the common words to make the training pairs, with the common words
        themselves as examples to keep. Common words cut anywhere, and compounds cut at their own hyphen, teach the joining of lines. At most
        most_pairs pairs of each kind train; the lexicon has all words.
        """
        r = random.Random(seed)
        plain = {w: n for w, n in counts.items() if w.isalpha()}
        alphabet = "".join(sorted({c for w in plain for c in w if c.isalpha() and c.islower()}))
        order = sorted(counts, key=lambda w: (-counts[w], w))
        common = {w for w, n in plain.items() if n >= LEAST_WORD}
        confused: Counter = Counter()
        bad: set[str] = set()
        mined: list[tuple[str, list[str]]] = []
        lost: dict[str, tuple[int, str, int]] = {}  # a common word without one character: its count, the word, the place
        for w in sorted(common):
            for k in range(1, len(w)):
                short = w[:k] + w[k + 1 :]
                if len(w) > 4 and (short not in lost or plain[w] > lost[short][0]):
                    lost[short] = (plain[w], w, k)
        for w in order:
            if len(w) < 4:
                continue
            n, best = counts[w], None
            for other, at, seen, meant in neighbours(w, alphabet):
                m = plain.get(other, 0)
                if m >= LEAST_WORD and n <= share * m and (best is None or m > best[0]):
                    best = (m, other, at, seen, meant)
            if best is None and w in lost and n <= 0.25 * share * lost[w][0]:  # weaker evidence: a form of the word may lack a character
                m, other, at = lost[w]
                best = (m, other, at, "", other[at])
            if best:
                _, other, at, seen, meant = best
                confused[seen, meant] += 1
                bad.add(w)
                mined.append((w, edits_of(w, other, at, seen, meant)))
        usual = [(k, n) for k, n in confused.items() if n >= max(3, 0.002 * sum(confused.values()))]
        trusted = {k for k, _ in usual}
        # a word differing by an unusual confusion is a word of its own
        bad = {
            w
            for w, ops in mined
            if any((w[i : i + 1 + ops[i + 1 :].count("del")] if o.startswith("rep:") else "", o[4:]) in trusted for i, o in enumerate(ops) if o[:4] in ("rep:", "ins:"))
        }
        good = sorted(w for w in common if w not in bad)
        by_meant: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for (seen, meant), n in usual:
            by_meant[meant] += [(seen, meant)] * min(n, 20)
        drawn = lambda rows, most: rows if len(rows) <= most else r.sample(rows, most)
        pairs = [(w, ["keep"] * len(w)) for w in drawn(good, most_pairs // 2)]
        pairs += drawn([(w, ops) for w, ops in mined if w in bad], most_pairs // 4)
        spots = [m for m in by_meant]
        while good and spots and len(pairs) < min(most_pairs, 12 * len(good) + 200):
            w = r.choice(good)
            here = [(i, m) for m in spots for i in range(1 if ("", m) in trusted else 0, len(w) - len(m) + 1) if w.startswith(m, i)]
            if not here or len(w) < 3:
                if len(pairs) > 11 * len(good):
                    break
                pairs.append((w, ["keep"] * len(w)))
                continue
            i, m = r.choice(here)
            seen, _ = r.choice(by_meant[m])
            noisy = w[:i] + seen + w[i + len(m) :]
            if noisy in counts and noisy not in bad:
                pairs.append((w, ["keep"] * len(w)))
                continue
            pairs.append((noisy, edits_of(noisy, w, i, seen, m)))
        kept = {w: counts[w] for w in good} | {w: n for w, n in counts.items() if "-" in w and n >= LEAST_COMPOUND}
        reader = cls(kept, Editor().fit(pairs))
        long = [w for w in good if len(w) > 5]
        cuts = [(w[:k], w[k:]) for w in (r.choice(long) for _ in range(min(most_pairs // 2, 6 * len(long)))) for k in [r.randint(2, len(w) - 2)]] if long else []
        own = [tuple(w.rsplit("-", 1)) for w in sorted(kept) if "-" in w]
        own = [(a.rsplit("-", 1)[-1], b) for a, b in own for _ in range(max(1, len(cuts) // (3 * len(own))))][: most_pairs // 2]
        reader.editor.fit_joins([(reader.join_features(a, b), True) for a, b in cuts] + [(reader.join_features(a, b), False) for a, b in own])
        return reader

    def known(self, word: str) -> bool:
        return word in self.counts

    def repair(self, word: str) -> tuple[str, list[str]] | None:
        """The common word that an unknown one stands for, and the edits; None if the editor keeps it or finds no common word."""
        low = word.lower()
        if low in self.counts:
            return None
        if low not in self.repaired:
            if len(self.repaired) > 200_000:
                self.repaired.clear()
            ops, now, found = self.editor.edit(low), low, None
            for _ in range(2):
                if all(o == "keep" for o in ops):
                    break
                now = apply_edits(now, ops)
                if now in self.counts:
                    found = (now, self.editor.edit(low))
                    break
                ops = self.editor.edit(now)
            self.repaired[low] = found
        return self.repaired[low]


@dataclass
class Page:
    """What became of a page: defects by line, and its body with words and lines put right."""

    defects: list[tuple[int, str]]
    body: list[str]  # repaired body lines; an empty string parts paragraphs
    open_end: bool  # the last word goes on on the next page


def furniture(lines: list[str], page: int, heads: list[str], offsets: list[int]) -> dict[int, str]:
    """running_head and page_number lines, by their place on the page and by what the document repeats there.

    heads: keys that recur in the zones of the document's pages; offsets: shown number less page number, as it recurs.
    """
    top, bottom = zones(lines)
    out: dict[int, str] = {}
    for zone in (top, bottom[::-1]):
        for depth, i in enumerate(zone):
            if i in out:
                continue
            if any(v - page in offsets or (not offsets and depth == 0 and v == page) for v in page_values(lines[i])):
                out[i] = "page_number"
                continue
            key = head_key(lines[i])
            if any(close(key, h) for h in heads):
                out[i] = "running_head"
    return out


def body_lines(lines: list[str], marks: dict[int, str]) -> list[int]:
    return [i for i in range(len(lines)) if i not in marks and lines[i].strip()]


class PageReader:
    def __init__(self, reader: Reader):
        self.reader = reader

    def breaks(self, line: str, following: str | None) -> tuple[str, str] | None:
        """(left, right) parts of a word cut at the end of a line by a mark that does not belong to it."""
        s = line.rstrip()
        if not s or s[-1] not in MARKS:
            return None
        left = re.search(r"[^\W_@|]*(?:[@|][^\W_]*)*(?:-[^\W_]+)*$", s[:-1])
        if following is None:  # the text goes on where nothing was read: only the left part can tell
            low = left[0].lower() if left else ""
            part = low.rsplit("-", 1)[-1]
            cut = len(part) > 1 and part.isalpha() and not self.reader.known(part) and (part in self.reader.heads or self.reader.repair(part) is None)
            return (left[0], "") if cut else None
        right = re.match(r"\s*([^\W_@|]*(?:[@|][^\W_]*)*(?:-[^\W_]+)*)", following)
        a, b = left[0] if left else "", right[1] if right else ""
        if not a or not b or not a[-1].isalpha() and a[-1] not in "@|" or not b[0].isalpha() and b[0] not in "@|" or b[0].isupper() and not a.isupper():
            return None
        r = self.reader
        low_a, low_b = a.lower().rsplit("-", 1)[-1], b.lower().split("-", 1)[0]
        joined = low_a + low_b
        compound = f"{low_a}-{low_b}"
        whole = (a + "-" + b).lower()
        n_join, n_comp = r.counts.get(joined, 0) if len(joined) > 2 else 0, max(r.counts.get(compound, 0), r.counts.get(whole, 0))
        if n_join or n_comp:
            return None if n_comp > n_join else (a, b)
        if s[-1] != "-":
            return a, b
        fixed = r.repair(joined)
        if fixed:
            return a, b
        fa, fb = r.repair(low_a), r.repair(low_b)  # a part with a wrong character counts as what it should be
        part_a, part_b = fa[0] if fa else low_a, fb[0] if fb else low_b
        if r.counts.get(f"{part_a}-{part_b}", 0) and len(low_b) > 3:
            return None
        return (a, b) if r.editor.joins(r.join_features(low_a, low_b)) else None

    def misread(self, word: str, first: bool, last: bool) -> str | None:
        """What a word should read, if some of its characters are wrong."""
        r, low = self.reader, word.lower()
        if r.known(low) or len(low) < 2:
            return None
        odd = any(c in SIGNS for c in low)
        if odd and re.fullmatch(r"[A-Za-z]{1,3}\d{1,5}|\d+[A-Za-z]{0,2}|[A-Z]\d?", word) and not re.search(r"[@|$€]", word):
            return None
        fixed = r.repair(low)
        if fixed:
            if len(low) < 4 and not odd:
                return None if r.counts[fixed[0]] < 50 or len(low) < 3 else fixed[0]
            if last and len(fixed[0]) != len(low) and low in r.heads or first and low in r.tails or last and low in r.heads:
                return None
            return fixed[0]
        if re.search(r"[^\W\d_][@|$€]|[@|$€][^\W\d_]{2}", low) or re.search(r"[^\W\d_]{2}\d[^\W\d_]|[^\W\d_]\d[^\W\d_]{2}|^\d[^\W\d_]{3}|[^\W\d_]{4}\d$", low):
            return low
        return None

    def read(self, lines: list[str], marks: dict[int, str], next_first: str | None, from_before: str | None) -> Page:
        """Defects of a page and its repaired body. next_first: the first body line of the next page; from_before: the left part of a
        word cut at the end of the page before."""
        defects = [(i, d) for i, d in marks.items()]
        rows = body_lines(lines, marks)
        out: list[str] = []
        carried, skip = from_before, len(from_before or "")
        last_row = None
        for n, i in enumerate(rows):
            line = lines[i]
            follow = lines[rows[n + 1]] if n + 1 < len(rows) else next_first
            cut = self.breaks(line, follow)
            text = line.rstrip()
            wrong, fixed_text, shift = False, text, 0
            spans = list(WORD.finditer(text))
            for k, m in enumerate(spans):
                w = m[0]
                if carried is not None and k == 0 and m.start() <= len(text) - len(text.lstrip()):
                    whole = carried.rsplit("-", 1)[-1] + w
                    fix = self.reader.repair(whole)
                    if fix:
                        at = next((x for x, o in enumerate(fix[1]) if o != "keep"), 0)
                        if at >= len(whole) - len(w):
                            wrong = True
                    elif not self.reader.known(whole.lower()) and re.search(r"[@|$€]", w):
                        wrong = True
                    continue
                if cut and k == len(spans) - 1 and m.end() >= len(text) - 1:
                    start = WORD.match((follow or "").lstrip())
                    whole = w + (start[0] if start else "")
                    fix = self.reader.repair(whole) if start else None
                    if fix:
                        at = next((x for x, o in enumerate(fix[1]) if o != "keep"), 0)
                        if at < len(w):
                            wrong = True
                    elif not self.reader.known(whole.lower()) and re.search(r"[@|$€]", w):
                        wrong = True
                    continue
                before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
                if (before == "-" and re.match(r"[A-Z]$", w)) or (after == "-" and re.match(r"[A-Z]{1,3}$", w)) or CODE.match(w) and not re.search(r"[a-z]{2}", w):
                    continue
                fix = self.misread(w, k == 0 and m.start() == 0, m.end() >= len(text))
                if fix is not None:
                    wrong = True
                    same = fix.capitalize() if w[:1].isupper() else fix
                    fixed_text = fixed_text[: m.start() + shift] + same + fixed_text[m.end() + shift :]
                    shift += len(same) - len(w)
            if re.search(r"(?<![^\W_])(?=[\dlIO|]*\d)(?=\d*[lIO|])[\dlIO|]{2,}(?:[.,][\dlIO|]+)?(?![^\W_])", text):
                wrong = True
            if wrong:
                defects.append((i, "misread"))
            if cut:
                defects.append((i, "hyphen_break"))
                fixed_text = fixed_text.rstrip()[:-1]
            if last_row is not None and any(not lines[x].strip() for x in range(last_row + 1, i)) and carried is None:
                out.append("")
            if carried is not None and out:
                out[-1] += fixed_text.lstrip()
            else:
                out.append(fixed_text)
            carried, last_row = (cut[0], i) if cut else (None, i)
        return Page(sorted(set(defects)), out, carried is not None)


def _pages(df: DataFrame, document: str, page: str, text: str) -> DataFrame:
    rows = df.select(F.col(document).cast("long").alias("doc"), F.col(page).cast("int").alias("page"), F.col(text).cast("string").alias("text"))
    return rows.where("doc is not null and page is not null and text is not null").groupBy("doc", "page").agg(F.max("text").alias("text"))


def _layout(pages: DataFrame) -> DataFrame:
    """doc, heads, offsets: what recurs at the edges of a document's pages. At most a few rows a page leave the tasks, and only keys that
    recur on a fifth of the pages are gathered, so at most thirty a document."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, p, t in zip(*(b.column(c).to_pylist() for c in range(3))):
                lines = t.split("\n")
                for name, zone in zip(("top", "bottom"), zones(lines)):
                    for i in zone:
                        values = page_values(lines[i])
                        rows += [(d, "number", str(v - p), p) for v in values]
                        if not values and len(k := head_key(lines[i])) >= LEAST_KEY:
                            rows.append((d, name, k, p))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int32()))], names=["doc", "zone", "key", "page"])

    seen = spread(pages).mapInArrow(edges, "doc long, zone string, key string, page int").distinct()
    count = seen.groupBy("doc", "zone", "key").agg(F.count("*").alias("n"))
    size = pages.groupBy("doc").agg(F.count("*").alias("pages"))
    often = count.join(size, "doc").where((F.col("n") >= 2) & (F.col("n") >= 0.2 * F.col("pages")))
    heads = F.collect_list(F.when(F.col("zone") != "number", F.col("key")))
    offsets = F.collect_list(F.when(F.col("zone") == "number", F.col("key").cast("int")))
    return often.groupBy("doc").agg(F.array_distinct(heads).alias("heads"), F.array_distinct(offsets).alias("offsets"))


def word_counts(pages: DataFrame, most_rare: int = 200_000) -> dict[str, int]:
    """Counts of the words within lines over all pages (ends of lines may be cut, so they stay out), and of hyphenated compounds.

    Every word and compound that occurs often enough for the lexicon is kept, whatever the size of the collection. Rarer ones only train
    the editor (as misread forms), so at most most_rare of them are drawn, by a hash of the word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for line in t.split("\n"):
                    ws = [(m[0], m.start(), m.end()) for m in COMPOUND.finditer(line)]
                    for w, _, _ in ws[1:-1]:
                        w = w.lower()
                        if w[0].isalpha() or w[0] in "@|0159":
                            if "-" in w:
                                if all(x.isalpha() for x in w.split("-")):
                                    c[w] += 1
                                    c.update(w.split("-"))
                            elif any(ch.isalpha() for ch in w) and len(w) > 1:
                                c[w] += 1
            if len(c) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)), pa.array(list(c.values()))], names=["word", "n"])
                c.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    each = materialize(spread(pages.select("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    enough = (F.col("n") >= LEAST_WORD) | F.col("word").contains("-") & (F.col("n") >= LEAST_COMPOUND)
    rare = each.where(~enough)
    share = int(1_000_000 * min(1.0, most_rare / max(rare.count(), 1)))
    rows = each.where(enough | (F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < share)).toArrow()
    return dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist()))


def _edges(pages: DataFrame, layout: DataFrame) -> DataFrame:
    """doc, page, lines and kinds of a page's furniture, and its first and last line of body text: all that the pages beside it need of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, p, t, heads, offsets in zip(*(b.column(c).to_pylist() for c in range(5))):
                lines = t.split("\n")
                marks = furniture(lines, p, heads or [], offsets or [])
                body = body_lines(lines, marks)
                rows.append((d, p, list(marks), list(marks.values()), lines[body[0]] if body else None, lines[body[-1]] if body else None))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "page", "at", "kind", "first", "last"])

    named = pages.join(layout, "doc", "left").select("doc", "page", "text", "heads", "offsets")
    return named.mapInArrow(run, "doc long, page int, at array<int>, kind array<string>, first string, last string")


def _with_context(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Each page with its furniture, the first body line of the next page and the last one of the page before (joined by number, so no document is gathered)."""
    after = edges.select("doc", (F.col("page") - 1).alias("page"), F.col("first").alias("after"))
    before = edges.select("doc", (F.col("page") + 1).alias("page"), F.col("last").alias("before"))
    beside = edges.select("doc", "page", "at", "kind").join(after, ["doc", "page"], "left").join(before, ["doc", "page"], "left")
    return pages.join(beside, ["doc", "page"]).select("doc", "page", "text", "at", "kind", "after", "before")


def _read_pages(reader: Reader):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pr = PageReader(reader)
        for b in batches:
            rows = []
            for d, p, t, at, kind, after, before in zip(*(b.column(c).to_pylist() for c in range(7))):
                lines, marks = t.split("\n"), dict(zip(at, kind))
                body = body_lines(lines, marks)
                cut = pr.breaks(before, lines[body[0]]) if before is not None and body else None
                done = pr.read(lines, marks, after, cut[0] if cut else None)
                rows.append((d, p, [i + 1 for i, _ in done.defects], [k for _, k in done.defects], "\n".join(done.body), done.open_end))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc", "page", "line_no", "defect", "body", "open_end"])

    return run


def read_scans(df: DataFrame, document: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """doc, page, line_no (array), defect (array), body, open_end of every page with a text.

    The editor is trained on the pages' own words (counts over all pages; the lexicon has every word of enough occurrences). Pages repeated exactly count once (of
    differing deliveries of one page the greater text is taken); null texts give no row; empty pages give empty arrays; null ids are
    left out; an empty table gives an empty table. Other columns are not read.
    """
    pages = materialize(_pages(df, document, page, text), "pages")
    reader = Reader.teach(word_counts(pages))
    edges = materialize(_edges(pages, _layout(pages)), "edges")
    return _with_context(pages, edges).repartition(parts(df.sparkSession)).mapInArrow(_read_pages(reader), "doc long, page int, line_no array<int>, defect array<string>, body string, open_end boolean")


def scan_defects(df: DataFrame, document: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """document, page, line_no (from 1), defect of every line of read_scans with one."""
    found = read_scans(df, document, page, text)
    rows = found.select("doc", "page", F.explode(F.arrays_zip("line_no", "defect")).alias("x"))
    return rows.select(F.col("doc").alias(document), F.col("page").alias(page), F.col("x.line_no").alias("line_no"), F.col("x.defect").alias("defect"))


def repaired_documents(df: DataFrame, document: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """document, text: the pages of a document as continuous paragraphs, parted by empty lines.

    Lines of a paragraph are joined by spaces, cut words without; a page that ends within a word or sentence goes on in the next one.
    """
    found = read_scans(df, document, page, text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "body", "open_end"))), lambda x: F.concat(x["body"], F.when(x["open_end"], "").when(x["body"].rlike(r"[.!?:]\s*$"), "\n\n").otherwise("\n"))), "")
    flat = F.regexp_replace(F.regexp_replace(joined, r"\n{2,}", "\u0001"), r"\s*\n\s*", " ")
    return found.groupBy("doc").agg(F.trim(F.regexp_replace(flat, "\u0001", "\n\n")).alias("text")).withColumnRenamed("doc", document)
