"""Template residue and error-page text (problem 8).

Method: one multi-pattern automaton runs once over each text and reports the openings of template slots, bad
values, the literals of filler and of instructions, and the literals of error messages and notices, in all their
languages. What the literals stand for is verified at their hits. A text that is nothing but messages is found by
coverage: the share of its letters inside message sentences, the words of web messages, and page furniture.

The wording (``wording``) comes from public default pages and common forms, not from a corpus; names of pages,
products and cases need not be known. The work is a projection: no shuffle, no state, each text whole, however
long, and linear in its length. The automaton is built once per Python worker.
"""

from __future__ import annotations

import re as plain_re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapelake.llm import wording

# Names a template gives its values; they tell a slot from a quotation, a tag or a formula where the
# delimiters alone don't (« », < >, $ $, : :, { }).
SLOT_NAMES = """action amount case case_id case_name cause change clock count date decision delta digest duration_ms effect
engine_version environment finding floor gate gate_name limit metric metric_label metric_value n next_step
number_of_regions operation outcome part part_name phase phase_no quality reason result review_date reviewer
reviewer_name role ruling runner score sha256 size stage stage_name state time total value verb verdict version
width_height name title author email address city country customer company product price url id id_number user user_name
username first_name last_name full_name phone subject body description summary placeholder variable field key""".split()

# Opening, closing, and what stands between: any expression (paths, hyphens, filters, letters of any script), a
# statement, any name, a name of a slot, or several words of such names.
SLOT_FORMS = [
    ("{{", "}}", "expression"),
    ("${", "}", "expression"),
    ("#{", "}", "expression"),
    ("<%=", "%>", "expression"),
    ("{%", "%}", "statement"),
    ("<insert ", ">", "name"),
    ("[insert ", "]", "name"),
    ("@@", "@@", "name"),
    ("[[", "]]", "expression"),
    ("__", "__", "name"),
    ("%(", ")s", "name"),
    ("[", "]", "words"),
    ("{", "}", "known"),
    ("<", ">", "known"),
    ("«", "»", "known"),
    ("$", "$", "known"),
    ("%", "%", "known"),
    (":", ":", "known"),
]
SLOT_TAILS = [" to be filled in)", " here]"]  # (x to be filled in), [x here]

# Values no writer leaves in a finished text.
BAD_VALUES = ["[object object]", "undefined", "xxx", "______", "%s", "tbd-"]

# In a sentence with one of these, a slot is spoken of, not left open.
SPEAKS_OF_SLOTS = [
    "template test",
    "the template",
    "template renders",
    "layout file",
    "placeholder",
    "vorlage ersetzt",
    "die vorlage",
    "la plantilla",
    "le modèle",
    "雛形",
    "テンプレート",
]

# Words whose mere run (this many in a row) is filler.
FILLER_RUNS = {"text": 5, "blah": 3, "bla": 3, "asdf": 3, "qwerty": 3, "xxxx": 3, "xxx": 3, "test": 5, "foo": 4, "abc": 4, "word": 5}
# The traditional filler's vocabulary; a run of six of these words, outside quotes, is filler.
LATIN = set(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt
culpa qui officia deserunt mollit anim id est laborum labor""".split()
)
LATIN_RUN = 6

COVERAGE = 0.85

# Of a sentence's letters, what words of messages must cover: in an error that counts by itself, in a sentence beside
# such an error, in a notice with what it is about, and in a notice without that (less if it plainly asks).
ERROR_SHARE = 0.74
SENTENCE_SHARE = 0.6
NOTICE_SHARE = 0.7
NOTICE_OWN = 0.6
ASKING_OWN = 0.4

_SPACES = plain_re.compile(r"[^\S\n]+")
_W = r"[\w\p{M}]"
_NAME = r"[a-z0-9_]+(?: [a-z0-9_]+)*+"
_ANY_NAME = rf"(?!\d){_W}++(?: {_W}++)*+"
_PATH = rf"(?!\d){_W}++(?:[.\-]{_W}++|\[{_W}++\])*+"
_INSIDE = {
    "expression": rf"[-$@.]? ?(?:{_PATH}(?: {_PATH})*+(?:\(\))?(?: ?\| ?{_PATH}(?: ?[:(][^\n{{}}|]*+)?)*+|{_NAME})",
    "statement": r"-? ?/?(?!\d)\w++(?: [^\n{}%]*+)?",
    "name": rf"(?:{_NAME}|{_ANY_NAME})",
    "known": _NAME,
    "words": _NAME,
}
_SLOTS = [re.compile(rf" ?({_INSIDE[kind]}) ?-?{re.escape(closing)}") for _, closing, kind in SLOT_FORMS]
_HEX = plain_re.compile(r"(?<![0-9a-z])(?=[0-9a-f]*\d)[0-9a-f]{4,64}(?![0-9a-z])")
_WORD = re.compile(r"[^\W_]+")
_TERM = plain_re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_SENTENCE = re.compile(r"[\n。]|[.!?](?=\s)")
_PARTS = plain_re.compile(r"[^.!?…;。！？]+(?:[.!?…;。！？]+(?!\s|$)[^.!?…;。！？]+)*[.!?…;。！？]*")
_INVISIBLE = plain_re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_QUOTES = [('"', '"'), ("“", "”"), ("「", "」"), ("„", "“")]
_TAGS = plain_re.compile(r"<[/!]?[a-z][^<>\n]*>")
_ASSIGNED = re.compile(r"(?:^|\s)(?:export |set |declare )?([a-z_][a-z0-9_]*)=", re.M)
_LOG = plain_re.compile(r"\W*\d{4}-\d\d-\d\d[t ]\d\d:\d\d")
_JSON_MARKS = plain_re.compile(r'[{}\[\]",]+')
_MENU = plain_re.compile(r" ?[|·•/»›«>—] ?")
_ASIAN = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_KNOWN = wording.VOCABULARY | wording.NAVIGATION
_TAIL_OPENS = {" to be filled in)": "(", " here]": "["}


def normalize(text: str) -> str:
    """Lower case, without invisible characters, each run of blanks one space; line breaks stay."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text).replace("’", "'")
    t = text.replace("\r\n", "\n").replace("\r", "\n").lower()
    return "\n".join(line.strip() for line in _SPACES.sub(" ", t).split("\n"))


@dataclass
class Detector:
    """The automaton with what is verified at its hits."""

    coverage: float = COVERAGE
    _auto: ahocorasick.Automaton = field(init=False)

    def __post_init__(self):
        found: dict[str, set] = {}
        for k, (opening, _, _) in enumerate(SLOT_FORMS):
            found.setdefault(opening, set()).add(("slot", k))
        for k, (_, _, anchors, _) in enumerate(wording.PROMPTS):
            for p in anchors:
                found.setdefault(p, set()).add(("prompt", k))
        for k, phrases in {
            "tail": SLOT_TAILS,
            "bad": BAD_VALUES,
            "speaks": SPEAKS_OF_SLOTS,
            "run": [f"{w} {w} {w}" for w in FILLER_RUNS],
            "latin": sorted(w for w in LATIN if len(w) >= 5),
            "message": wording.ANCHORS,
        }.items():
            for p in phrases:
                found.setdefault(p, set()).add((k, None))
        self._auto = ahocorasick.Automaton()
        for p, kinds in found.items():
            self._auto.add_word(p, (len(p), sorted(kinds, key=str)))
        self._auto.make_automaton()
        self._names = set(SLOT_NAMES)

    # -- places

    @staticmethod
    def _code(t: str) -> list[tuple[int, int]]:
        """Spans between back quotes: fenced blocks (an open fence runs to the end) and code in a line."""
        out, i = [], 0
        while (i := t.find("`", i)) >= 0:
            if t.startswith("```", i):
                end = t.find("```", i + 3)
                end = len(t) if end < 0 else end + 3
            else:
                end = t.find("`", i + 1)
                line = t.find("\n", i + 1)
                if end < 0 or (0 <= line < end):
                    i += 1
                    continue
                end += 1
            out.append((i, end))
            i = end
        return out

    @staticmethod
    def _inside(spans: list[tuple[int, int]], at: int) -> bool:
        k = bisect_right(spans, (at, len(spans) and 1 << 60)) - 1
        return k >= 0 and spans[k][0] <= at < spans[k][1]

    @staticmethod
    def _quoted(t: str) -> list[tuple[int, int]]:
        """Quotations within running text: opened after a word, closed in the same line. The strings of JSON
        come after a colon, brace or comma, and are no quotations."""
        out = []
        for a, b in _QUOTES:
            i = 0
            while (i := t.find(a, i)) >= 0:
                end = t.find(b, i + 1)
                line = t.find("\n", i + 1)
                if end < 0 or 0 <= line < end:
                    i += 1
                    continue
                before = t[max(0, i - 2) : i].rstrip(" ")
                if before and before[-1] not in ":,{[\n" or a in "「“„":
                    out.append((i, end + 1))
                i = end + 1
        return sorted(out)

    @staticmethod
    def _sentence(t: str, a: int, b: int) -> tuple[int, int]:
        start = max(t.rfind("\n", 0, a), t.rfind("。", 0, a), t.rfind(". ", 0, a)) + 1
        m = _SENTENCE.search(t, b)
        return start, m.start() if m else len(t)

    # -- checks

    def _slot(self, t: str, k: int, at: int) -> tuple[int, int, str] | None:
        """The slot opened at ``at``: whatever stands between must be of the form's kind, however long. The patterns
        fail at the first letter that can't be inside, so a text of openings costs no more than its length."""
        opening, closing, kind = SLOT_FORMS[k]
        if kind == "known" and at and (t[at - 1] in "{$#<%[«:" or (opening in ":%$" and (t[at - 1].isalnum() or t[at - 1] == opening))):
            return None
        start = at + len(opening)
        m = _SLOTS[k].match(t, start)
        if not m or not m.group(1):
            return None
        name = m.group(1).strip()
        if kind == "words":  # [customer name], but no link
            parts = re.split("[ _]", name)
            if len(parts) < 2 or t[m.end() : m.end() + 1] in ("(", "[") or not all(p in self._names for p in parts):
                return None
        if kind == "known":
            key = name.replace(" ", "_")
            if key not in self._names and "_" not in name and not (opening == "{" and key.isdigit()):
                return None
            if opening in ":%$" and m.end() != start + len(name) + len(closing):
                return None
        return at, m.end(), name

    def residue(self, t: str, hits: list) -> tuple[int, int] | None:
        """Where a slot was left open or badly filled, or filler or an instruction stands in the place of content."""
        code = quotes = assigned = None
        speaks = [(a, t[a:b]) for a, b, kind, _ in hits if kind == "speaks"]
        tried: set[tuple[int, int]] = set()  # (prompt, line) pairs that were looked at

        def spoken_of(a: int, b: int, but: str = "") -> bool:
            nonlocal code
            code = self._code(t) if code is None else code
            if self._inside(code, a):
                return True
            if not speaks:
                return False
            s, e = self._sentence(t, a, b)
            return any(s <= x < e and w != but for x, w in speaks)

        def in_quotes(a: int) -> bool:
            nonlocal quotes
            quotes = self._quoted(t) if quotes is None else quotes
            return self._inside(quotes, a)

        tail_end = 0
        latin_end, words, latin, latin_hits = -99, 0, 0, 0
        for a, b, kind, k in hits:
            if kind == "slot":
                slot = self._slot(t, k, a)
                if slot and not spoken_of(slot[0], slot[1]):
                    if SLOT_FORMS[k][0] in ("${", "%"):
                        assigned = set(_ASSIGNED.findall(t)) if assigned is None else assigned
                        if slot[2] in assigned or slot[2].split("-")[0] in assigned:  # ${name-default}
                            continue
                    return a, b
            elif kind == "tail":
                s = t.rfind(_TAIL_OPENS[t[a:b]], max(tail_end, t.rfind("\n", tail_end, a) + 1), a)
                tail_end = b
                name = t[s + 1 : a].strip()
                if s >= 0 and re.fullmatch(_NAME, name) and name != "write" and not spoken_of(s, b):
                    return a, b
            elif kind == "bad":
                word = t[a:b]
                left, right = t[a - 1 : a], t[b : b + 1]
                if word == "tbd-":
                    if left.isalnum() or not right.isalpha():
                        continue
                elif word in ("undefined", "xxx"):
                    # Japanese sets values without blanks, so only letters of the same script bound the word.
                    if (left.isascii() and (left.isalnum() or left == "_")) or (right.isascii() and (right.isalnum() or right == "_")):
                        continue
                    if word == "xxx" and left == "x":
                        continue
                elif word == "%s" and ((left.isascii() and left.isalnum() and left != "t") or (right.isascii() and right.isalnum() and right != "t" and right != "z")):
                    continue
                if not spoken_of(a, b) and not in_quotes(a):
                    return a, b
            elif kind == "prompt":
                start = t.rfind("\n", 0, a) + 1
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                end = t.find("\n", b)
                at = self._prompt(t, k, start, len(t) if end < 0 else end, in_quotes, spoken_of)
                if at:
                    return at
            elif kind == "run":
                word = t[a:b].split(" ", 1)[0]
                if (a == 0 or not t[a - 1].isalnum()) and not in_quotes(a):
                    n, i = 0, a
                    while t.startswith(word, i) and n < FILLER_RUNS[word]:
                        n, i = n + 1, i + len(word)
                        while i < len(t) and t[i] in " \n.,":
                            i += 1
                    if n >= FILLER_RUNS[word] and not t[a + len(word)].isalnum():
                        return a, b
            elif kind == "latin":
                if (a and t[a - 1].isalpha()) or t[b : b + 1].isalpha():
                    continue
                if a - latin_end > 24:
                    words = latin = latin_hits = 0
                else:
                    between = _WORD.findall(t, latin_end, a)
                    words, latin = words + len(between), latin + sum(w in LATIN for w in between)
                words, latin, latin_hits, latin_end = words + 1, latin + 1, latin_hits + 1, b
                if latin_hits >= LATIN_RUN // 2 and not in_quotes(a):
                    more = _WORD.finditer(t, b, min(len(t), b + 80)) if words < LATIN_RUN else ()
                    following = [m.group() for m, _ in zip(more, range(LATIN_RUN - words), strict=False)]
                    n, good = words + len(following), latin + sum(w in LATIN for w in following)
                    if n >= LATIN_RUN and good >= 0.75 * n:
                        return a, b
        return None

    @staticmethod
    def _prompt(t: str, k: int, start: int, end: int, in_quotes, spoken_of) -> tuple[int, int] | None:
        """Filler or an instruction in one line: filler anywhere outside quotes, an instruction as the whole line,
        apart from list marks and a label before it."""
        kind, pattern, _, whole = wording.PROMPTS[k]
        if not whole:
            for m in pattern.finditer(t, start, end):
                if not in_quotes(m.start()) and not spoken_of(m.start(), m.end(), "placeholder"):
                    return m.span()
            return None
        line = t[start:end].strip(" .…").lstrip("-*•>#0123456789.) ")
        label = re.match(r"[\w ]{1,24}: ", line)
        for part in (line, line[label.end() :] if label else ""):
            if part and pattern.fullmatch(part):
                return start, end
        return None

    def only_messages(self, t: str, spots: list[int]) -> bool:
        """Nothing but error messages or notices, with or without page furniture, by coverage of the letters. Stops
        as soon as what is not covered is too much for the text's length. ``spots`` are the places of the automaton's
        hits: a sentence without any can't be a message."""
        most = (1 - self.coverage) * len(t)
        quotes = None
        total = rest = labels = 0
        strong = False
        at = 0
        for line in t.split("\n"):
            start, at = at, at + len(line) + 1
            if not line.strip():
                continue
            row = line.startswith("|") and line.count("|") > 1
            as_json = line[0] in "{[" and line[-1] in "}]"
            plain = _JSON_MARKS.sub("\n", line.replace("_", " ")) if as_json else line
            plain = _TAGS.sub("\n", plain) if "<" in plain else plain
            no_message = row or bool(_LOG.match(line))
            for piece in plain.split("\n"):
                if not no_message and not as_json and piece == line and self._furniture(piece.strip(), bisect_left(spots, start) < bisect_left(spots, at)):
                    n = sum(map(len, _TERM.findall(piece)))
                    known = all(w in wording.NAVIGATION for w in _TERM.findall(piece)) or len(_MENU.split(piece.strip(" «»|/·•"))) > 1
                    if known or labels + n <= 40:
                        total, labels = total + n, labels if known else labels + n
                        continue
                for m in _PARTS.finditer(piece):
                    sentence = m.group()
                    a, b = start + m.start(), start + m.end()
                    hit = piece != line or bisect_left(spots, a) < bisect_left(spots, b)
                    letters, known = self._letters(sentence, hit and not no_message)
                    if not letters:
                        continue
                    total += letters
                    if no_message or not hit:
                        directive = not no_message and self._order(sentence, known, letters)
                        asks = not no_message and wording.ASIAN_END.search(sentence.strip(" 。!！?？"))
                        rest += 0 if directive or asks else letters - known * (not no_message)
                        continue
                    quoted, speaks = 0, False
                    outside = sentence
                    quotes = self._quoted(t) if quotes is None else quotes
                    if quotes and not as_json and piece == line:
                        for x, y in quotes:
                            if x < b and y > a:
                                x, y = max(x, a) - a, min(y, b) - a
                                quoted += sum(map(len, _TERM.findall(sentence[x:y])))
                                outside = outside[:x] + " " * (y - x) + outside[y:]
                                speaks |= wording.is_message(sentence[x:y])
                    asian = len(_ASIAN.findall(sentence))
                    if speaks or quoted > 0.3 * letters:
                        rest += letters
                    elif asian > 0.2 * letters:
                        if wording.is_message(outside) and letters <= 80:
                            strong = True
                        elif not wording.ASIAN_END.search(sentence.strip(" 。!！?？")):
                            rest += letters
                    elif self._evidence(outside, known, letters):
                        strong = True
                    elif known >= SENTENCE_SHARE * letters and wording.is_message(outside) or self._order(outside, known, letters):
                        pass  # goes with a message, but is none by itself
                    else:
                        rest += letters - known
                if rest > most:
                    return False
        return strong and rest <= (1 - self.coverage) * total

    @staticmethod
    def _about(sentence: str) -> int:
        """Letters of what a notice or an order is about that aren't words of messages."""
        return sum(len(w) for m in wording.OBJECT.finditer(sentence) for w in _TERM.findall(m.group(1)) if w not in _KNOWN)

    def _evidence(self, sentence: str, known: int, letters: int) -> bool:
        """An error, or a notice whatever it is about, that makes a text a message."""
        if known >= ERROR_SHARE * letters and wording.is_message(sentence):
            return True
        notice = wording.is_notice(sentence) or wording.CHECK.search(sentence)
        return bool(notice) and known + self._about(sentence) >= NOTICE_SHARE * letters and known >= (ASKING_OWN if wording.ASKING.search(sentence) else NOTICE_OWN) * letters

    def _order(self, sentence: str, known: int, letters: int) -> bool:
        """What a page tells its reader to do, or that it is loading."""
        return bool(wording.LOADING.match(sentence) or (wording.DIRECTIVE.match(sentence) and known + self._about(sentence) >= NOTICE_SHARE * letters and known >= ASKING_OWN * letters))

    @staticmethod
    def _letters(sentence: str, patterns: bool) -> tuple[int, int]:
        """Letters of a sentence, ids left out, and those in words of web messages or in what the patterns match."""
        text = _HEX.sub(lambda m: " " * len(m.group()), sentence) if not sentence.isalpha() and any(map(str.isdigit, sentence)) else sentence
        letters = known = 0
        if not patterns:
            for w in _TERM.findall(text):
                letters += len(w)
                if w in _KNOWN:
                    known += len(w)
                elif "'" in w:
                    known += sum(len(x) for x in w.split("'") if x in wording.VOCABULARY)
            return letters, known
        open_ = []
        for m in _TERM.finditer(text):
            w = m.group()
            letters += len(w)
            if w in _KNOWN:
                known += len(w)
            elif "'" in w and any(x in wording.VOCABULARY for x in w.split("'")):
                known += sum(len(x) for x in w.split("'") if x in wording.VOCABULARY)
            else:
                open_.append(m.span())
        if open_ and known > 0.3 * letters:
            spans, i = wording.covered(text), 0
            for a, b in open_:
                while i < len(spans) and spans[i][1] <= a:
                    i += 1
                known += b - a if any(x < b and y > a for x, y in spans[i : i + 4]) else 0
        return letters, known

    @staticmethod
    def _furniture(line: str, hit: bool) -> bool:
        """A menu (several short labels), a line of navigation words, or one short label."""
        if line[-1:] in ".!?。！？:" or ": " in line:
            return False
        parts = [p for p in _MENU.split(line.strip(" «»|/·•")) if p]
        words = _TERM.findall(line)
        if not words:
            return False
        if hit and wording.is_message(line):
            return False
        if len(parts) > 1 and all(len(p.split()) <= 3 for p in parts):
            return True
        return all(w in wording.NAVIGATION for w in words) or (len(words) <= 3 and not any(c.isdigit() for c in line))

    def kind(self, text: str | None) -> str | None:
        """'residue', 'message' or None. Null, empty, blank and merely short texts are no case."""
        if not text:
            return None
        t = normalize(text)
        hits = [(end + 1 - n, end + 1, kind, k) for end, (n, kinds) in self._auto.iter(t) for kind, k in kinds]
        if not hits:
            return None
        if self.residue(t, hits):
            return "residue"
        spots = sorted(a for a, _, kind, _ in hits if kind == "message")
        return "message" if spots and self.only_messages(t, spots) else None


def flag_residue(df: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Ids of the texts to exclude, with the kind: 'residue' or 'message'.

    Equal texts under several ids all come out; null, empty and blank texts never; a null id keeps its row;
    other columns, of whatever name, are not read. An empty table gives an empty result.
    """
    schema = df.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(coverage)
        for batch in batches:
            kinds = [detector.kind(x) for x in batch.column(1).to_pylist()]
            keep = pa.array([k is not None for k in kinds])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([k for k in kinds if k], pa.string())], names=["doc_id", "kind"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {schema}, kind string")
