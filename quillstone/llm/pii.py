"""Personal information in free text: found, and replaced by typed placeholders.

Anchor expansion. One Aho-Corasick pass over a text finds its anchors: at-signs
and their disguises, identifier cues, box and route words, street words, given
names. Numbers are anchors by their shape. From each anchor a deterministic
local parser grows to the left and right and checks the item: the boundaries
and labels of an e-mail address, the digit groups of a phone or identity
number, the parts of a street address, the order of a person's name.

Kinds: NAME, ADDRESS, PHONE, EMAIL, ID. Overlapping finds keep the longer one,
by the order EMAIL, ID, PHONE, ADDRESS, NAME where equal.

Texts are read once and never shuffled; given names come as a bounded list.

Defined results. NULL, empty and blank texts hold nothing and stay as they are.
Positions count characters from 1 in the text as given. Very long texts are
read whole; every parser looks at a bounded neighbourhood of its anchor.
Repeated rows are reported once.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.scannoise import class_lines

KINDS = ("EMAIL", "ID", "PHONE", "ADDRESS", "NAME")
#: Bytes of given names that may travel to the tasks, and how many of them the automaton takes; with more, capital words are looked up instead.
NAMES_BYTES, AUTOMATON_NAMES = 64 * 1024 * 1024, 100_000

#: Common given names, added to those the caller knows.
GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Daniel Nancy Matthew Lisa Anthony Betty Mark Margaret Donald Sandra Steven Ashley Paul Kimberly Andrew Emily Joshua Donna Kenneth Michelle Maria Jose Carlos"
).split()
_STREET = {
    "street", "st", "avenue", "ave", "boulevard", "blvd", "road", "rd", "lane", "ln", "drive", "dr", "court", "ct", "way", "parkway", "pkwy", "place", "pl", "circle",
    "cir", "terrace", "ter", "highway", "hwy", "square", "sq", "trail", "trl", "pike", "turnpike", "loop", "alley", "row",
}
_NOT_STREET = {"prov", "app", "fed", "cir", "supp", "dec", "rep", "pages", "page", "paragraph", "section"}
#: Words that end the name of a firm or place, so what stands before them is no person.
_FIRM = re.compile(
    r"[\s,]*(?:&|and\s+(?:Associates|Partners|Sons|Co)\b|(?:Inc|Corp|Corporation|Co|Company|LLC|LLP|Ltd|L\.?L\.?[CP]|P\.?C|L\.P|P\.A|PLLC|Group|Holdings|Bank|Insurance|Mutual|"
    r"Associates|Partners|Legal|Law|Society|Foundation|Trust|Hall|Building|County|Courthouse|Center|Centre|School|University|"
    r"Hospital|Church|Park|Bridge|Library|Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Court|Way|Parkway|Boulevard|Blvd|Public|Defender|Award|Prize|Act|Rule|Room|Wing|Tower|House|Memorial|College|Station)\b)",
    re.I,
)
_NO_SURNAME = {
    "the", "a", "an", "in", "on", "of", "and", "or", "at", "by", "to", "for", "we", "he", "she", "it", "this", "that", "these", "under", "until", "whether", "because", "costs", "only", "no", "not", "if", "even",
    "page", "case", "court", "judge", "exhibit", "paragraph", "hall", "will", "may", "shall", "counsel", "accordingly", "according", "nothing", "having", "interest", "taken", "three", "such", "what", "neither", "phone",
    "fax", "tel", "email", "addr", "name", "rural", "post", "box", "po", "box", "document", "opinion", "rep", "app", "dec", "ct", "cir", "fed", "prov", "united", "states", "state", "estate", "inc", "llc",
    "service", "as", "but", "so", "who", "whose", "then", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "jr", "sr", "ii", "iii", "iv", "attorney", "lead",
    "reply", "make", "please", "exhibit", "see", "summary", "all", "by", "further", "respectfully", "call", "bates", "order", "motion", "notice", "plaintiff", "defendant", "law", "offices", "office", "bar", "pro", "my", "our", "i",
}

_WORD = r"[^\W\d_](?:[^\W_]|['’@$|](?=[^\W_]))*(?:-[^\W\d_][^\W\d_]+)?"
_CAP = rf"(?=[A-Z0|$1]){_WORD.replace('[^' + chr(92) + 'W' + chr(92) + 'd_](?', '[A-Z0|$1](?', 1)}"
_INITIAL = r"[A-Z]\."
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?at\s?[)\]}>]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\sdot\s)"
_LOCAL = re.compile(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s)[A-Za-z0-9!#$%&'*+/=?^_`{|}~\-]+)*$", re.I)
_LOCAL_HERE = re.compile(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.\-]+")
_AT_HERE = re.compile(_AT, re.I)
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9\-]{{0,62}})(?:{_DOT}[A-Za-z0-9\-]{{1,63}})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I)
_PHONE = re.compile(
    r"(?<![\d\w$§.#\-/(])(?<!\d[ .\-/])(?:(?:\+1|1)[ .\-/]?\s?)?(?:\(\s?([2-9]\d\d)\s?\)\s{0,2}[.\-/]?|([2-9]\d\d)(?:[ .\-/]|\s)\s?|([2-9]\d\d)(?=[2-9]\d{6}))([2-9]\d\d)(?:[ .\-\n]|-\s\n?|\s{2})?\s?(\d{4})(?![\d]|[\-/.,]\d|-[A-Za-z])"
)
#: Words and marks that announce a phone or fax number.
_PHONE_CUES = ("call", "phone", "tel", "cell", "fax", "reach", "mobile", "dial", " ph", "text", "voice", "(o)", "(f)", "(c)", "(m)", " f:", " o:", " p:", " c:", " m:", " t:", "tel:", "sms:")
_AFTER_CUE = re.compile(r"\W{0,4}\w{0,8}\W{0,5}(?:at\s+)?")
_URL_END = re.compile(r"[\s<>\"]|$")
_NOT_PHONE = re.compile(r"(?:account|acct|check|case|docket|bates|part|order|invoice|policy|serial|item|sku|bar|page|claim|lot|tracking)\s?(?:no|number|nos|range)?[.:#]*\s*$", re.I)
_SSN = re.compile(r"(?<![\w\-.#$/])(\d{3})([\- .])\s?(\d\d)\2\s?(\d{4})(?![\w\-]|\.\d|/\d)")
_ALIEN = re.compile(r"(?<![\w\-])A(?:#\s?)?[ \-]?(?:\d{3}[ \-]\s?\d{3}[ \-]\s?\d{3}|\d{8,9}|\d{2}[ \-]\d{3}[ \-]\d{3})(?![\w\-])")
_NOT_ID = re.compile(r"(?:account|acct|check|cheque|case|docket|bates|part|order|invoice|policy|serial|item|sku|bar|page|claim|lot|tracking|routing|member)\s?(?:no|number|nos|range|id)?[.:#]*\s*$", re.I)
_GAP = r"(?:\s*(?:no|nos|number|num|nr|id|is|was|card|#|:|-|–|\.|,|\(|of|his|her|the|reads|listed|as))*\s*[.:#]*\s*"
_TAX_ID = re.compile(_GAP + r"((?:\d{3}[\- .]?\s?\d\d[\- .]?\s?\d{4}|\d\d-\d{7}))(?![\w\-])", re.I)
_LICENSE = re.compile(_GAP + r"([A-Z]{1,2}[ \-]?\s?\d{2,6}(?:[ \-]\s?\d{2,6}){1,3}|[A-Z]{1,2}[ \-]?\d{6,12}|\d{7,9})(?![\w\-])")
_LICENSE_GAP = re.compile(r"\s*(?:[Nn]o|[Nn]umber|NO|NUMBER|[Nn]um|#|:|is|was|\.|,|\()*\s*[.:#]*\s*")
_PASSPORT = re.compile(r"([A-Z]{0,2}\s?\d{6,9})(?![\w\-])")
_BOX = re.compile(r"(?:P\.?\s?O\.?\s+Box|Post\s+Office\s+Box|P0\s+Box)\s+#?\s?\d{1,6}", re.I)
_ROUTE = re.compile(r"(?:Rural\s+Route|R\.?R\.?|RFD|Star\s+Route|Highway\s+Contract)\s+#?\s?\d{1,4}[A-Z]?(?:,?\s+Box\s+\d{1,6}[A-Z]?)?", re.I)
_LEFT_STREET = re.compile(r"(?<![\w$§.#\-/(:])(\d{1,5}(?:-\d{1,4})?[A-Z]?)\s+((?:(?:[NSEW]\.?|North|South|East|West|NE|NW|SE|SW|NORTH|SOUTH|EAST|WEST)\s+)?(?:\d{1,3}(?:st|nd|rd|th|ST|ND|RD|TH)\s+|[A-Z0|$][\w'’@$|\-]*\s+){1,4})$")
_TAIL_ADDRESS = re.compile(
    r"\.?(?:[,\s]+(?:#|Apt|Apartment|Suite|Ste|Unit|Fl|Floor|Rm|Room|No)\.?\s*\d+\s?[A-Z]?(?![a-z]))?(?:,?\s+[A-Z][\w'.]+(?:\s+[A-Z][\w'.]+){0,2},\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?(?!\d))?"
)
_TITLE = re.compile(r"(?:Mr|Mrs|Ms|Miss|Dr|Officer|Hon|Prof|Sgt|Det|Detective|Deputy|Agent|Nurse|Rev|Capt|Lt)\.?\s+$")
_BREAK = re.compile(r"(?<=[^\W\d_])[-­¬‐][ \t]*\r?\n[ \t]*(?=[a-z])|[­¬][ \t]*\r?\n[ \t]*")
_SUFFIX = re.compile(r"(?:,?\s+(?:Jr|Sr)\.|,?\s+(?:II|III|IV)\b)")

_PAGE_BREAK = re.compile(r"\n[ \t\f]*(?:[\[*~\-]\s?\d{1,4}\s?[\]~\-]?|(?i:page\s)\d{1,4}|\d{1,4})[ \t]*\n|\f")

#: Readings of a scan that count as the same letters when given names and street words are looked up.
_SAME = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("li", "h"), ("ü", "ti")]
_ONE = str.maketrans("l10c@5$fu9v68|", "iioeasstngybbi")


def scan_key(word: str) -> str:
    w = word.lower()
    for a, b in _SAME:
        w = w.replace(a, b)
    return w.translate(_ONE)


_STREET_KEYS = {scan_key(w) for w in _STREET if len(w) > 2} | {w for w in _STREET}


#: Words, misread ones too, that begin no name with an initial in the middle.
_NOT_FIRST = {scan_key(w) for w in (*_NO_SURNAME, "neither", "nor", "mr", "mrs", "ms", "miss", "dr", "officer", "hon", "prof", "sgt", "det", "detective", "deputy", "agent", "nurse", "rev", "capt", "lt")} | {scan_key(w.replace("fi", "ﬁ").replace("ffi", "fﬁ")) for w in ("officer",)}


class Finder:
    """Automaton and gazetteer; made once in each Python worker."""

    held: dict[int, "Finder"] = {}

    def __init__(self, given: Iterable[str], firms: Iterable[str] = ()):
        import ahocorasick

        self.firms = {w.lower() for w in firms}

        names = {g.strip().lower() for g in [*given, *GIVEN] if g and len(g.strip()) > 1 and g.strip().isalpha()}
        self.given = names
        self.asked: dict[str, bool] = {}
        self.given_keys = {scan_key(n) for n in names if len(n) > 3}
        a = ahocorasick.Automaton()
        cues = {"@": "at", "(at)": "at", "[at]": "at", "{at}": "at", "<at>": "at", "( at )": "at", "[ at ]": "at", " at ": "at word"}
        cues |= {w: "tax" for w in ("ssn", "social security", "social sec", "taxpayer", "tax id", "tin ", "itin", "ein ", "tax identification")}
        cues |= {w: "license" for w in ("license", "licence", "driver", "d.l.")} | {"passport": "passport", "passp0rt": "passport", "passporf": "passport"}
        cues |= {" box": "box", "route": "route", "r.r.": "route", " rr ": "route", "rfd": "route"}
        cues |= {f" {w}": "street" for w in _STREET if len(w) > 1}
        cues |= {"mailto:": "mail scheme", "http://": "url", "https://": "url", "ftp://": "url", "www.": "url"}
        cues |= {w: "phone" for w in _PHONE_CUES}
        for w, kind in cues.items():
            a.add_word(w, (kind, len(w)))
        self.listed = len(names) <= AUTOMATON_NAMES
        for w in names if self.listed else ():
            if not a.exists(w):
                a.add_word(w, ("given", len(w)))
        a.make_automaton()
        self.cues = a

    @classmethod
    def of(cls, key: int, given: Iterable[str], firms: Iterable[str] = ()) -> "Finder":
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = cls(given, firms)
        return cls.held[key]

    def is_given(self, word: str) -> bool:
        if (known := self.asked.get(word)) is not None:
            return known
        if len(self.asked) > 300_000:
            self.asked.clear()
        self.asked[word] = found = self._is_given(word)
        return found

    def _is_given(self, w: str) -> bool:
        w = w.strip(".,'’")
        return len(w) > 1 and (w.lower() in self.given or len(w) > 3 and scan_key(w) in self.given_keys)

    def find(self, text: str, contact: bool = False) -> list[tuple[str, int, int]]:
        """(kind, start, end) of every item, by place; ``contact`` for contact blocks, which begin with a name.

        Where a page ends inside an item, its running head and page number lie between the item's parts.
        """
        found = self._find(text, contact)
        if contact or not _PAGE_BREAK.search(text):
            return found
        lines = text.split("\n")
        kept, cuts, lost, at, gone = [], [], [], 0, 0
        for line, kind in zip(lines, class_lines(lines)):
            if kind in ("header", "page_no"):
                gone += len(line) + 1
                cuts.append(at)
                lost.append(gone)
            else:
                kept.append(line)
                at += len(line) + 1
        if not cuts:
            return found
        back = lambda p: p + (lost[i - 1] if (i := bisect_right(cuts, p)) else 0)
        view, across = "\n".join(kept), set()
        for cut in dict.fromkeys(cuts):
            begin = max(0, cut - 160)
            for k, s, e in self._find(view[begin : cut + 160], contact):
                if s + begin < cut < e + begin:
                    across.add((k, back(s + begin), back(e + begin - 1) + 1))
        whole = [f for f in found if all(f[2] <= s or f[1] >= e for _, s, e in across)]
        return sorted([*whole, *across], key=lambda f: f[1])

    def _find(self, text: str, contact: bool) -> list[tuple[str, int, int]]:
        found: list[tuple[int, int, int]] = []  # (start, end, kind number)
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        low = low.replace("\n", " ").replace("\r", " ").replace("\t", " ").replace("\xa0", " ")
        given: list[int] = []
        called: list[int] = []  # ends of cues of phone numbers
        urls: list[tuple[int, int]] = []
        for end, (kind, n) in self.cues.iter(low):
            at = end - n + 1
            if kind == "given":
                if (at == 0 or not (low[at - 1].isalnum() or low[at - 1] in "@._")) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                    given.append(at)
                continue
            if kind == "phone":
                called.append(end + 1)
            elif kind == "url":
                if not urls or at >= urls[-1][1]:
                    urls.append((at, _URL_END.search(text, end + 1).start()))
            elif kind == "mail scheme":
                if (m := _LOCAL_HERE.match(text, end + 1)) and (a := _AT_HERE.match(text, m.end())) and (right := _DOMAIN.match(text, a.end())):
                    found.append((end + 1, right.end(), 0))
            elif kind in ("at", "at word"):
                self._email(text, at, kind, found)
            elif kind == "tax":
                if m := _TAX_ID.match(text, end + 1):
                    found.append((m.start(1), m.end(1), 1))
            elif kind in ("license", "passport"):
                stop = end + 1
                if kind == "license" and low.startswith("driver", at):
                    continue  # the word license follows
                if kind == "license" and not low[max(0, at - 12) : at].strip().endswith(("driver's", "driver’s", "drivers", "driver", "dl", "operator's", "driver'5")):
                    continue
                stop = _LICENSE_GAP.match(text, stop).end()
                m = (_PASSPORT if kind == "passport" else _LICENSE).match(text, stop)
                if m and not re.fullmatch(r"\D*", m.group(1)):
                    found.append((m.start(1), m.end(1), 1))
            elif kind == "box":
                if (m := _BOX.match(text, start := max(0, at - 12))) or (m := _BOX.search(text, start, end + 12)):
                    if m.start() <= at <= m.end():
                        found.append((m.start(), self._address_end(text, m.end()), 3))
            elif kind == "route":
                if (m := _ROUTE.search(text, max(0, at - 8), end + 24)) and m.start() <= end and (m.start() == 0 or not text[m.start() - 1].isalnum()):
                    if text[m.start() : m.start() + 1] in "RrSH" and not text[m.start() :].startswith("Route"):
                        found.append((m.start(), self._address_end(text, m.end()), 3))
            elif kind == "street":
                stop = end + 1
                if stop == len(text) or not text[stop].isalnum():
                    self._street(text, at + 1, stop, found)
        self._numbers(text, contact, called, urls, found)
        if "\n" in text:
            self._scanned_streets(text, found)
        self._names(text, contact, given, found)
        return self._settle(found)

    def _email(self, text: str, at: int, kind: str, found: list) -> None:
        m = _AT_HERE.match(text, at - 1 if at and text[at] != " " and text[at - 1] in " \n" else at) or _AT_HERE.match(text, at)
        if not m:
            return
        right = _DOMAIN.match(text, m.end())
        width = 80
        while (left := _LOCAL.search(text[max(0, m.start() - width) : m.start()])) and left.start() == 0 and width < m.start():
            width *= 4  # the mailbox may begin further left
        if not right or not left:
            return
        if kind == "at word" and not re.search(r"dot", right.group(), re.I) and not re.fullmatch(r"\S+\.(?:com|org|net|edu|gov|example|test|invalid)", right.group(), re.I):
            return
        start = max(0, m.start() - width) + left.start()
        for scheme in ("mailto:",):
            if text[start:].lower().startswith(scheme):
                start += len(scheme)
        found.append((start, right.end(), 0))

    def _address_end(self, text: str, end: int) -> int:
        m = _TAIL_ADDRESS.match(text, end)
        return m.end() if m else end

    def _street(self, text: str, word: int, stop: int, found: list) -> None:
        m = _LEFT_STREET.search(text[max(0, word - 70) : word])
        if not m or not text[word].isupper():
            return
        names = m.group(2).split()
        if names[-1].strip(".").lower() in _NOT_STREET or any(n.lower().strip(".,") in ("the", "of", "and") for n in names):
            return
        found.append((max(0, word - 70) + m.start(), self._address_end(text, stop), 3))

    _SCANNED = re.compile(r"(?<![\w$§.#\-/(:])\d{2,5}\s+(?:(?:[NSEW]\.|[A-Z][\w@$|]+|\d{1,2}th)\s+){1,3}([A-Z5$][\w@$|]{2,8})(?=[,.\s])")

    def _scanned_streets(self, text: str, found: list) -> None:
        """Street words with misread letters."""
        for m in self._SCANNED.finditer(text):
            w = m.group(1).lower()
            if w not in _STREET and len(w) > 3 and scan_key(w) in _STREET_KEYS:
                found.append((m.start(), self._address_end(text, m.end()), 3))

    def _numbers(self, text: str, contact: bool, called: list[int], urls: list[tuple[int, int]], found: list) -> None:
        for m in _SSN.finditer(text):
            if not _NOT_ID.search(text[max(0, m.start() - 30) : m.start()]):
                found.append((m.start(), m.end(), 1))
        for m in _ALIEN.finditer(text):
            if not _NOT_ID.search(text[max(0, m.start() - 30) : m.start()]):
                found.append((m.start(), m.end(), 1))
        last = -99
        for m in _PHONE.finditer(text):
            before = text[max(0, m.start() - 30) : m.start()]
            if _NOT_PHONE.search(before) or any(a <= m.start() < z for a, z in urls):
                continue
            if m.group().isdigit() and not self._announced(text, m.start(), m.end(), contact, called, last):
                continue
            found.append((m.start(), m.end(), 2))
            last = m.end()

    @staticmethod
    def _announced(text: str, start: int, end: int, contact: bool, called: list[int], last: int) -> bool:
        """Whether ten bare digits are a phone number: a cue stands before them, another phone number is named with them, or they are a line of a contact block."""
        for c in reversed(called[: bisect_right(called, start)]):
            if start - c > 26:
                break
            if (m := _AFTER_CUE.match(text, c)) and m.end() >= start or text[c:start].isspace() or c == start:
                return True
        if last > start - 24 and re.fullmatch(r"\W*(?:(?:ext|x)\W{0,3}\d{1,5})?\W*(?:to|and|or|from)?\W*", text[last:start], re.I):
            return True
        return contact and not re.search(r"[^\s,;][^\S\r\n]*\Z", text[max(0, start - 40) : start]) and re.match(r"\s*(?:[,;\r\n]|$)", text[end:]) is not None

    # Names -----------------------------------------------------------------------------------------------------

    _GIVEN_FIRST = re.compile(rf"(?<![\w@.+\-])({_CAP})((?:\s+(?:{_INITIAL}|[A-Z](?=\s)))*)\s*(?<=[\s.])({_CAP})(?:\s+({_CAP}))?")
    _LAST_FIRST = re.compile(rf"(?<![\w@.+\-])({_CAP}),\s+({_CAP})(?:\s+[A-Z]\b\.?)?")
    _CAPS = re.compile(rf"(?<![\w@.+\-]){_CAP}")
    _BEFORE = re.compile(rf"(?<![\w@.+\-])({_CAP}),\s+$")
    #: Names by shape, whatever the given name: after a title, or with an initial in the middle.
    _TITLED = re.compile(rf"(?<![\w.])(?:Mr|Mrs|Ms|Miss|Dr|Officer|Prof|Sgt|Det|Detective|Deputy|Nurse|Rev|Capt|Lt)\.?\s+(({_CAP})(?:\s+{_INITIAL})?\s+({_CAP}))")
    _MIDDLE = re.compile(rf"(?<![\w@.+\-])({_CAP})\s+{_INITIAL}\s+({_CAP})")
    _INITIALS = re.compile(rf"(?<![\w.&@§])(?:{_INITIAL}\s*){{1,3}}(?<=[\s.])({_CAP})")

    def _ok_surname(self, w: str) -> bool:
        return len(w) > 2 and w.lower().strip(".") not in _NO_SURNAME and not self._firm(w)

    def _firm(self, w: str) -> bool:
        return w.lower() in self.firms or _FIRM.fullmatch(" " + w) is not None

    def _clean(self, view: str, start: int, end: int) -> bool:
        """Whether what stands around makes the words no caption, firm or place."""
        if _FIRM.match(view, end) or re.match(r"\s+v[s]?\.\s|\s+V\.\s", view[end : end + 6]):
            return False
        nxt = re.match(rf"\s+({_CAP})(?:\s+({_CAP}))?(?:\s+({_CAP}))?", view[end : end + 60])
        if nxt and "\n" not in view[end : end + 3] and not re.search(r"s/\s*$", view[max(0, start - 4) : start]) and not _TITLE.search(view[max(0, start - 14) : start]):
            for w in nxt.groups():
                if w and self._firm(w):
                    return False
        return not re.search(r"(?:\sv[s]?\.|\sV\.|\bIn re|\bEstate of|\bMatter of|\bOffices? of|&)\s*$", view[max(0, start - 14) : start])

    def _names(self, text: str, contact: bool, given: list[int], found: list) -> None:
        # A view with words joined again that a line end broke; starts are mapped back.
        cuts: list[int] = []
        gone: list[int] = []
        parts, last, lost = [], 0, 0
        for m in _BREAK.finditer(text):
            parts.append(text[last : m.start()])
            lost += m.end() - m.start()
            cuts.append(m.end() - lost)
            gone.append(lost)
            last = m.end()
        view = "".join([*parts, text[last:]]) if cuts else text

        def add(start: int, end: int) -> None:
            s = _SUFFIX.match(view, end)
            end = s.end() if s else end
            back = [p + (gone[i - 1] if (i := bisect_right(cuts, p)) else 0) for p in (start, end)]
            found.append((back[0], back[1], 4))

        taken: list[tuple[int, int]] = []
        scanned = bool(cuts) or text.count("\n") > 3 and max(map(len, text.split("\n"))) < 115
        if scanned or contact or not self.listed:  # given names may be broken or misread: every word with a capital is looked at
            starts = [m.start() for m in self._CAPS.finditer(view) if self.is_given(m.group())]
        else:
            starts = given
        for p in starts:  # "Surname, Given"
            back = self._BEFORE.search(view[max(0, p - 45) : p])
            if not back:
                continue
            start = max(0, p - 45) + back.start(1)
            m = self._LAST_FIRST.match(view, start)
            if not m or m.start(2) != p:
                continue
            last_name = m.group(1)
            if not self._ok_surname(last_name) or self.is_given(last_name) or not self._clean(view, m.start(), m.end()):
                continue
            rest = view[m.end(2) :][:60]
            if not contact and (nxt := re.match(rf"\s+({_CAP})", rest)) and not re.match(r"\s+[A-Z]\b", rest) and self._ok_surname(nxt.group(1)) and nxt.group(1)[1:].islower():
                continue  # "..., Surname, Given Surname" is a list of two
            before = view[max(0, start - 24) : start]
            if not contact and (w := re.search(rf"({_CAP})\s$", before)) and self._ok_surname(w.group(1)) and not _TITLE.search(before):
                continue
            add(m.start(), m.end())
            taken.append((m.start(), m.end()))
        inside = lambda p: any(a <= p < b for a, b in taken)
        for p in starts:  # "Given Surname"
            m = None if inside(p) else self._GIVEN_FIRST.match(view, p)
            if not m:
                continue
            last_name, more, end = m.group(3), m.group(4), m.end(3)
            if more and "\n" not in view[m.end(3) : m.start(4)] and (self.is_given(last_name) or len(last_name) == 1) and self._ok_surname(more):
                end, last_name = m.end(4), more
            gap = view[m.end(1) : m.start(3)]
            if self._ok_surname(last_name) and gap.count("\n") <= 1 and self._clean(view, p, end):
                add(p, end)
                taken.append((p, end))
        for titled, form in ((True, self._TITLED), (False, self._MIDDLE)):
            for m in form.finditer(view):
                first, start, end = (m.group(2), m.start(1), m.end(1)) if titled else (m.group(1), m.start(), m.end())
                last_name = m.group(3 if titled else 2)
                if inside(start) or inside(end - 1) or not self._ok_surname(first) or not self._ok_surname(last_name) or not first[1:].replace("-", "").isalpha() or not self._clean(view, start, end):
                    continue
                if not titled and ("\n" in view[start:end] or scan_key(first) in _NOT_FIRST or re.search(r"\s[Vv]\.", m.group()) or re.search(r"[A-Z][\w'&]*\.?,?\s+$|\d\s+$|§\s*$", view[max(0, start - 30) : start])):
                    continue
                add(start, end)
                taken.append((start, end))
        for m in self._INITIALS.finditer(view):
            if inside(m.start()) or inside(m.start(1)) or not self._ok_surname(m.group(1)) or re.match(r"[NSEWMC]\.\s?D\.", m.group()):
                continue  # "S.D." is a court's district
            w = view[max(0, m.start() - 20) : m.start()]
            if not self._clean(view, m.start(), m.end()) or re.search(r"\d\s+$|§\s*$", w) and not _TITLE.search(w):
                continue
            if (cap := re.search(r"([A-Z][\w']+)\.?,?\s$", w)) and cap.group(1).lower() not in ("neither", "name", "nor", "to", "by") and not _TITLE.search(w):
                continue
            if re.match(r"\s+(?:Street|St|Ave|Road|Lane|Drive|Way|Court|Parkway|Blvd)\b", view[m.end() : m.end() + 12]):
                continue
            add(m.start(), m.end())
            taken.append((m.start(), m.end()))
        if contact:
            self._contact_name(view, taken, add)

    _CONTACT = re.compile(r"\s*((?P<a>[^\W\d_][^\W\d_'’-]*)(?P<mid>(?:\s+[A-Za-z]\b\.?|\s?\.?[A-Z]\.)*)\s*(?P<b>[^\W\d_][^\W\d_'’-]+)(?:\s+(?P<c>[^\W\d_]{3,}))?|(?P<l>[^\W\d_]{3,}),\s+(?P<f>[^\W\d_]{2,})(?:\s+[A-Za-z]\b\.?)?)(?=(?:,?\s+(?:[JjSs][Rr]|I{2,3}|IV)\b\.?)?\s*(?:,|$))")

    def _contact_name(self, view: str, taken: list, add) -> None:
        """A contact block begins with its person, also where the given name is misspelt, in small letters or bare initials."""
        if any(a < 40 for a, _ in taken):
            return
        line = re.match(r"[^\r\n]*", view).group()
        m = self._CONTACT.match(line)
        if not m or "&" in line[: m.end() + 3] or _FIRM.match(view, m.end(1)) or any(self._firm(w) for w in m.group(1).split()):
            return
        words = m.group(1).replace(",", " ").split()
        if any(w.lower() in _NO_SURNAME for i, w in enumerate(words) if len(w.strip(".")) > 1 and not (i == 0 and len(w) == 2 and w.isupper())):
            return
        first = m.group("a") or m.group("f")
        initials = len(first) <= 2 and first.isupper() and len(words) == 2 and not words[1].isupper()
        near = len(first) > 3 and any(_one_edit(first.lower(), g) for g in self.given if abs(len(g) - len(first)) <= 1)
        if initials or near or self.is_given(first):
            add(m.start(1), m.end(1))

    @staticmethod
    def _settle(found: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
        out: list[tuple[int, int, int]] = []
        for s, e, k in sorted(set(found), key=lambda x: (x[2] if x[2] < 4 else 9, x[0] - x[1])):
            if all(e <= a or s >= b for a, b, _ in out):
                out.append((s, e, k))
        return [(KINDS[k], s, e) for s, e, k in sorted(out)]


def _one_edit(a: str, b: str) -> bool:
    """Whether one insertion, deletion, change or swap of neighbours leads from a to b."""
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or y[1:] == x or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def redact(text: str | None, finder: Finder, contact: bool = False) -> str | None:
    """The text with ``[NAME]``, ``[ADDRESS]``, ``[PHONE]``, ``[EMAIL]`` and ``[ID]`` in place of its items."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e in finder.find(text, contact):
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def given_names(people: DataFrame, column: str) -> list[str]:
    """Distinct given names of a table of people; they travel to the tasks, so they may have ``NAMES_BYTES`` bytes in all, which is millions."""
    names = people.select(F.lower(F.trim(F.col(column))).alias("n")).where(F.length("n") > 1).distinct()
    size = names.agg(F.sum(F.octet_length("n"))).first()[0] or 0
    if size > NAMES_BYTES:
        raise ValueError(f"{size} bytes of given names, more than {NAMES_BYTES}")
    return sorted(r[0] for r in names.collect())


def firm_words(cases: DataFrame, column: str, least: int = 20) -> list[str]:
    """Words that captions show as parts of firms' names: in ``least`` captions at least, mostly right before the form of a company, after different words.

    A word in at least one of 5,000 captions is kept, so no more than some thousands come back.
    """
    form = r"(?:Inc|Corp|Corporation|Co|Company|LLC|LLP|Ltd|L\.?P|L\.?L\.?C|Group|Bank|Holdings)\b"
    rows = cases.select(F.col(column).alias("c")).where(F.col("c").isNotNull())
    shown = rows.select(F.explode(F.regexp_extract_all("c", F.lit(rf"(\p{{Lu}}[\p{{L}}'’]+ \p{{Lu}}[\p{{L}}]+) {form}"), F.lit(1))).alias("p"))
    before = shown.select(F.split_part("p", F.lit(" "), F.lit(1)).alias("a"), F.lower(F.split_part("p", F.lit(" "), F.lit(2))).alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.approx_count_distinct("a").alias("heads"))
    everywhere = rows.select(F.explode(F.split(F.lower("c"), r"[^\p{L}]+")).alias("w")).groupBy("w").agg(F.count("*").alias("total"))
    share = F.greatest(F.lit(least), F.lit(rows.count()) / 5000)
    return sorted(r["w"] for r in before.join(everywhere, "w").where((F.col("n") >= share) & (2 * F.col("n") >= F.col("total")) & (F.col("heads") >= 5)).select("w").collect())


def find_pii(df: DataFrame, src: str, key: str, text: str, given: list[str], contact: bool = False, firms: list[str] = ()) -> DataFrame:
    """(src, row_id, pii_kind, start_pos, end_pos) of each item; end_pos is the place after its last character."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).where(F.col("t").rlike(r"\S"))
    stamp = hash((*given, "", *firms))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder.of(stamp, given, firms)
        for b in batches:
            at, kinds, starts, ends = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for kind, s, e in finder.find(t, contact):
                    at.append(i)
                    kinds.append(kind)
                    starts.append(s + 1)
                    ends.append(e + 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["row_id", "pii_kind", "start_pos", "end_pos"])

    found = rows.mapInArrow(run, "row_id bigint, pii_kind string, start_pos int, end_pos int")
    return found.dropDuplicates().select(F.lit(src).alias("src"), "*")


def redact_column(df: DataFrame, key: str, text: str, given: list[str], contact: bool = False, firms: list[str] = ()) -> DataFrame:
    """(row_id, redacted) of every row."""
    rows = df.select(F.col(f"`{key}`").alias("row_id"), F.col(f"`{text}`").alias("t"))
    stamp = hash((*given, "", *firms))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        finder = Finder.of(stamp, given, firms)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, finder, contact) for t in b.column(1).to_pylist()], pa.string())], names=["row_id", "redacted"])

    return rows.mapInArrow(run, f"row_id {rows.schema[0].dataType.simpleString()}, redacted string")
