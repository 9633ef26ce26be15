"""Personal data in free text: found by anchors, bounded by local parsers, replaced by typed placeholders.

An Aho-Corasick automaton runs once over the text (in its one consistent form, see ``lookalikes``) and
reports anchors: at-signs and their spellings, cues of identity numbers, street words, titles,
phrases that introduce a person, and known names; runs of digits are anchors of phone numbers. A deterministic parser per kind expands each anchor to the left
and right, validates what it finds (labels and top-level domain of an address, digits of a phone number,
length of an identity number, a house number next to a street) and yields a span. Where spans overlap, the kind that
was validated more strictly wins. Spans are positions in the original text, so all the rest stays as it was.

Defined results: a null text has no findings and stays null; an empty text stays empty; texts of any
length are read whole; a placeholder of an earlier scrubber (``<redacted>``) is no finding.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lookalikes import Rewriter, default_rewriter

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID_NUMBER>", "street_address": "<ADDRESS>", "person_name": "<NAME>"}
#: The list of known names is shipped to every worker; a list above this size is refused.
MAX_NAMES = 200_000

# Cues of identity numbers and the most digits that such a number has.
ID_CUES = {
    "ssn": 9, "social security": 9, "social insurance": 9, "my social": 9, "sozialversicherung": 12, "seguridad social": 12,
    "sécurité sociale": 15, "numéro de sécu": 15, "national insurance": 6, "ni number": 6, "ni no": 6, "nino": 6, "aadhaar": 12, "aadhar": 12,
    "passport": 9, "reisepass": 9, "passeport": 9, "pasaporte": 9, "tax id": 11, "tax number": 11, "tax no": 11, "tin": 11,
    "steuer-id": 11, "steuer id": 11, "steueridentifikationsnummer": 11, "steuernummer": 13, "numéro fiscal": 13, "nif": 9, "dni": 8, "nie": 8,
    "itin": 9, "licence": 12, "license": 12, "driving permit": 12, "führerschein": 12, "permis de conduire": 12, "permiso de conducir": 12, "carnet de conducir": 12,
    "personalausweis": 10, "ausweis": 10, "identity card": 12, "id card": 12, "carte d'identité": 12, "carte nationale": 12, "national id": 12,
    "documento de identidad": 10, "cédula": 11, "curp": 16, "nhs number": 10, "medicare": 11, "versicherungsnummer": 12, "insurance number": 10, "insurance no": 10,
}
# Words that may stand between such a cue and its number.
ID_FILLERS = frozenset("no nr number num nº n° # is was on file ist es est lautet number: für for of the de del und and card id code: code the: número numéro nummer s".split())
# Street words that follow a name (1600 Lantern Street), that precede it (Calle, rue) and that end it (Lanternweg 3).
STREET_AFTER = frozenset(
    "street st road rd avenue ave lane ln drive dr boulevard blvd court ct mews row way place pl terrace close square sq crescent parkway pkwy highway hwy circle trail alley walk gardens grove hill quay wharf".split()
)
STREET_SHORT = frozenset("st rd ave ln dr blvd ct pl sq pkwy hwy".split())
STREET_BEFORE_NUMBER = frozenset("calle c/ avenida avda plaza paseo carrer ronda camino travesía via viale piazza".split())
STREET_AFTER_NUMBER = frozenset("rue avenue av boulevard bd place chemin impasse allée quai cours route passage square ruelle".split())
STREET_ENDINGS = ("straße", "strasse", "str.", "str", "weg", "allee", "platz", "gasse", "ring", "damm", "ufer", "chaussee", "steig")
# Words that can't be part of a street's own name, in the languages of the texts.
NOT_IN_STREET = frozenset("for the of to in and or on at a an is was were are as with by from results into that this after before per results test tool view returned el y und der die das et ou que pour dans".split())
_SHORT_WORD = re.compile(r"[A-Za-z]\.|(?:st|mt|dr)\.", re.I)
UNIT = re.compile(r",?\s+(?:apt|apartment|suite|ste|unit|flat|floor|room)\.?\s+#?\w{1,5}\b", re.I)
FLOOR = re.compile(r",?\s+\d{1,2}\s?[ºª°oa](?:\s+[a-z]\b)?", re.I)
TOWN = re.compile(r",\s+(?:\d{4,5}\s+)?[A-ZÄÖÜÉÀ][^\W\d_]+(?:-[A-ZÄÖÜÉÀ][^\W\d_]+)?(?: [A-ZÄÖÜÉÀ][^\W\d_]+(?=,? +\d{4,5}\b|[,.;\n]|$))?(?:,?\s+[A-Z]{2}(?=\s+\d{5}))?(?:\s+\d{4,5}(?:-\d{4})?\b)?")
LOWER_TOWN = re.compile(r",\s+[^\W\d_]+\s+\d{4,5}\b|,\s+[^\W\d_]{3,}(?=\s*(?:[.;|\n)]|$))")

# Words before a number that say that it is no phone number.
NOT_PHONE = frozenset(
    "request invoice order ticket item sku batch row offset room card tracking ref reference case build version node suite trace column id no number code serial hash ip factura rechnung facture pedido bestellung commande iban konto account part port commit run seq line lot ending".split()
)
#: The shortest phone number has so many digits.
LEAST_DIGITS = 8
#: So many words before a number without separators may say that it is a phone number.
CUE_WORDS = 5
PHONE_CUES = ("phone", "call", "text me", "tel", "mobil", "reach", "joindre", "erreichen", "rang", "teléfono", "téléphone", "fax", "whatsapp", "sms", "cell", "ring", "rappel", "llame", "anrufen", "contact")

# Titles, phrases that introduce a person, and closings that a name follows.
TITLES = frozenset("mr mrs ms miss dr prof madame monsieur mme mlle herr frau señor señora sr sra srta don doña sir".split())
NAME_CUES = (
    "my name is", "this is", "je m'appelle", "mein name ist", "ich heiße", "ich bin", "me llamo", "mi nombre es", "account holder:", "account holder is", "colleague", "spoke with", "signed by", "i asked",
    "transcript quotes", "name:", "nom:", "nombre:", "customer:", "client:", "attn:", "dear", "hi", "hello", "hallo", "bonjour", "hola", "sehr geehrter", "sehr geehrte", "chère", "cher", "estimado", "estimada",
    '"customer": "', '"name": "', '"contact_name": "', "kontoinhaber:", "titulaire:", "titular:", "when", "c/o", "ask for", "gezeichnet", "kollege", "kollegin", "collègue", "compañero", "compañera",
)
#: After these phrases other words than names are as likely; a name must show itself.
WEAK_CUES = frozenset(("this is", "i asked", "when", "colleague", "hi", "hello", "hallo", "bonjour", "hola", "dear", "ich bin", "name:", "ask for", "cher", "chère", "kollege", "kollegin"))
CLOSINGS = ("regards", "cheers", "thanks", "thank you", "best", "sincerely", "yours", "grüße", "gruß", "grüßen", "cordialement", "merci", "saludos", "gracias", "atentamente", "--", "love", "bien à vous", "salutations")
PARTICLES = frozenset("de la las los del van von der den di da du le el al bin ten ter zu dos das y e".split())
# Given names that are ordinary words too; alone they are names only where a name is expected.
ORDINARY = frozenset(
    "april may june august rose faith grace will mark grant hope joy art bill dawn summer autumn amber ruby pearl ivy iris lily daisy heather olive sage robin jack pat rob sue frank ernest earl max chase drew dean guy glen clay cliff miles reed wade ward page see".split()
)
FIRMS = frozenset("holdings ltd limited gmbh inc corp llc ag plc group partners company co kg sarl s.a sa bv logistics industries systems bank labs".split())

_TOKEN = re.compile(r"(?<![\w])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\d_])")
_NEXT = re.compile(r"[ \t]{1,2}|,[ \t]|[ \t]*\n")


def _word_char(c: str) -> bool:
    return c.isalnum() or c == "_"


def _blanks_left(text: str, at: int) -> int:
    """Begin of the white space that ends at ``at``."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    return at


def _words_left(text: str, at: int, most: int) -> int:
    """Begin of the last ``most`` words before ``at``."""
    for _ in range(most):
        at = _blanks_left(text, at)
        while at > 0 and not text[at - 1].isspace():
            at -= 1
    return at


def _word_before(low: str, at: int) -> str:
    """The word before ``at``, with only marks and blanks between them."""
    end = at
    while end > 0 and (low[end - 1].isspace() or low[end - 1] in ".:#=\"'-"):
        end -= 1
    begin = end
    while begin > 0 and low[begin - 1].isalpha():
        begin -= 1
    return low[begin:end]


class Names:
    """Known given and family names, and the parts that family names are made of."""

    def __init__(self, rows: Iterable[tuple[str, str]]) -> None:
        self.given: set[str] = set()
        self.family: set[str] = set()
        for kind, name in rows:
            if not name:
                continue
            words = [w.lower() for w in _TOKEN.findall(name)]
            if kind == "given":
                self.given.update(words)
            elif words:
                self.family.add(words[-1])
        starts: dict[str, int] = {}
        ends: dict[str, int] = {}
        for name in self.family:
            for cut in range(3, len(name) - 1):
                starts[name[:cut]] = starts.get(name[:cut], 0) + 1
                ends[name[cut:]] = ends.get(name[cut:], 0) + 1
        self.starts = {x for x, n in starts.items() if n >= 3 and len(x) <= 6}
        self.ends = {x for x, n in ends.items() if n >= 2 and len(x) >= 3}

    def is_family(self, word: str) -> bool:
        """A known family name, or one made of a beginning and an ending that several known ones share."""
        w = word.lower().removesuffix("'s").removesuffix("’s")
        if w in self.family:
            return True
        if "-" in w:
            return all(self.is_family(x) or len(x) > 2 and x in self.ends for x in w.split("-")) and self.is_family(w.split("-")[0])
        return len(w) >= 6 and w not in _COMMON and any(w[:cut] in self.starts and w[cut:] in self.ends for cut in range(3, len(w) - 1))

    def is_given(self, word: str) -> bool:
        w = word.lower()
        return w in self.given or "-" in w and all(x in self.given for x in w.split("-"))


class Finder:
    """Anchors and parsers; ``spans`` gives the findings of a text in its consistent form."""

    def __init__(self, names: Names) -> None:
        self.names = names
        anchors: dict[str, set[tuple[str, str]]] = {}

        def add(word: str, kind: str) -> None:
            anchors.setdefault(word, set()).add((kind, word))

        for word in ("@", "[at]", "(at)", "{at}", " at ", "<at>"):
            add(word, "email")
        for cue in ID_CUES:
            add(cue, "id")
        for word in STREET_AFTER:
            add(f" {word}", "street_after")
        for word in STREET_BEFORE_NUMBER:
            add(f"{word} ", "street_before")
        for word in STREET_AFTER_NUMBER:
            add(f" {word} ", "street_mid")
        for word in STREET_ENDINGS:
            add(f"{word} ", "street_end")
        for word in TITLES:
            add(word, "title")
        for cue in NAME_CUES:
            add(cue, "cue")
        for cue in CLOSINGS:
            add(cue, "closing")
        for word in names.given:
            add(word, "given")
        for word in names.family:
            add(word, "family")
        # endings of family names lead to names that aren't in the list
        for word in names.ends:
            if len(word) >= 3:
                add(word, "ending")
        self.automaton = ahocorasick.Automaton()
        for word, kinds in anchors.items():
            whole = all(kind in ("given", "family", "ending") for kind, _ in kinds)
            self.automaton.add_word(word, (word, tuple(kind for kind, _ in kinds), whole))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        by_kind: dict[str, list[tuple[int, int, str]]] = {}
        for end, (word, kinds, whole) in self.automaton.iter(low):
            end += 1
            if whole and end < len(low) and low[end].isalpha():
                continue  # names end where a word ends
            for kind in kinds:
                by_kind.setdefault(kind, []).append((end - len(word), end, word))
        taken: list[tuple[int, int, str]] = []
        taken += self._emails(text, low, by_kind.get("email", []))
        taken = _free(taken, self._ids(text, low, by_kind.get("id", [])))
        taken = _free(taken, self._streets(text, low, by_kind))
        taken = _free(taken, self._phones(text, low))
        taken = _free(taken, self._persons(text, low, by_kind, taken))
        return sorted(taken)

    # --- email -------------------------------------------------------------------------------------------------

    _DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:(?:\.|\s?[\[({]dot[\])}]\s?|\s+dot\s+)[^\W_](?:[\w-]*[^\W_])?)+", re.I)
    _SPLIT = re.compile(r"\.|\s?[\[({]dot[\])}]\s?|\s+dot\s+", re.I)
    _SPELLED_DOT = re.compile(r"\bdot\b", re.I)
    _BLANK_DOT = re.compile(r"\s+dot\s+", re.I)

    @staticmethod
    def _dot_left(text: str, low: str, at: int) -> int | None:
        """Begin of a spelled-out dot that ends at ``at``."""
        i = _blanks_left(text, at)
        if i < at and low.endswith("dot", 0, i) and (k := _blanks_left(text, i - 3)) < i - 3:
            return k
        if at - i <= 1 and i >= 5 and text[i - 1] in "])}" and low.endswith("dot", 0, i - 1) and text[i - 5] in "[({":
            return i - 5 - text[i - 6 : i - 5].isspace() if i > 5 else 0
        return None

    def _spelled_left(self, text: str, low: str, at: int) -> int:
        """Begin of the words with spelled-out dots that end at ``at`` (``at`` itself if there are none)."""
        while (dot := self._dot_left(text, low, at)) is not None:
            word = dot
            while word > 0 and (_word_char(text[word - 1]) or text[word - 1] in "+-"):
                word -= 1
            while word < dot and not text[word].isalnum():
                word += 1
            if word == dot or text[word - 1 : word] == "." and word:
                break
            at = word
        return at

    def _emails(self, text: str, low: str, hits: list) -> list[tuple[int, int, str]]:
        out = []
        for start, end, word in hits:
            left = start
            while left > 0 and text[left - 1] == " " and start - left < 2:
                left -= 1
            first = left
            while first > 0 and (_word_char(text[first - 1]) or text[first - 1] in ".+%'-"):
                first -= 1
            if first == left:
                continue
            right = end
            while right < len(text) and text[right] == " " and right - end < 2:
                right += 1
            domain = self._DOMAIN.match(text, right)
            if not domain:
                continue
            labels = self._SPLIT.split(domain.group())
            if word == " at " and (not self._SPELLED_DOT.search(domain.group()) or low.startswith(" at ", domain.end()) and self._DOMAIN.match(text, domain.end() + 4)):
                continue  # no address, or the words before one ("is at ann dot lee at home dot net")
            if "." in domain.group() and self._BLANK_DOT.search(domain.group()) is None and not labels[-1].isalpha():
                while labels and not labels[-1].isalpha():
                    labels.pop()
            if len(labels) < 2 or not labels[-1].isalpha() or not 2 <= len(labels[-1]) <= 24:
                continue
            stop = domain.end()
            name = text[first:left].lstrip(".'-+%").rstrip(".'")
            if not name:
                continue
            begin = first + text[first:left].index(name)
            if word != "@":
                begin = self._spelled_left(text, low, begin)
            # a sentence that goes on without a blank after the full stop is no further label
            if len(labels) > 2 and labels[-1][:1].isupper() and not labels[0][:1].isupper() and domain.group().count(".") == len(labels) - 1:
                stop -= len(labels[-1]) + 1
            out.append((begin, stop, "email"))
        return _merged(out)

    # --- identity numbers --------------------------------------------------------------------------------------

    _MARKS = re.compile(r"[\s:#'’=(\"-]*")
    _FILLER = re.compile(r"[^\W\d]+[º°.]?(?![\w-])|nº|n°")
    _GROUP = re.compile(r"[A-Za-z]{0,4}\d[A-Za-z\d]*|[A-Za-z]{1,3}(?![A-Za-z])")

    def _ids(self, text: str, low: str, hits: list) -> list[tuple[int, int, str]]:
        out = []
        passed, done = 0, -1  # the fillers from ``passed`` on end at ``done``
        for start, end, word in hits:
            if start > 0 and low[start - 1].isalnum() or end < len(low) and low[end].isalpha() and not low.startswith("s", end) and word not in ("ausweis", "sozialversicherung", "licence"):
                continue
            at = end
            while at < len(low) and low[at].isalpha():
                at += 1
            begin = at
            while not passed <= at < done:  # fillers and marks between cue and number, as many as there are
                at = self._MARKS.match(low, at).end()
                w = self._FILLER.match(low, at)
                if not w or w.group().strip("º°.") not in ID_FILLERS and w.group() not in ("nº", "n°"):
                    break
                at = w.end()
            else:
                at = done
            passed, done = begin, at
            span = self._id_number(text, at, ID_CUES[word])
            if span:
                out.append((*span, "id_number"))
        return _merged(out)

    def _id_number(self, text: str, at: int, most: int) -> tuple[int, int] | None:
        begin = stop = at
        digits = letters_only = 0
        while True:
            m = self._GROUP.match(text, stop if stop == begin else stop + 1)
            if not m:
                break
            n = sum(c.isdigit() for c in m.group())
            if n == 0:
                last = len(m.group()) == 1 and (m.group().isupper() or letters_only > 0) and text[stop - 1].isdigit() and most <= 8 and digits >= 6
                if digits and not last or not digits and letters_only or len(m.group()) > 3:
                    break
                if not digits and m.group().islower() and m.group() in _COMMON and text[m.end() : m.end() + 1].isspace():  # a word of the sentence
                    begin = stop = self._MARKS.match(text, m.end()).end()
                    continue
                if digits:
                    stop = m.end()
                    break
                letters_only += 1
            elif digits + n > most + 1:
                break
            digits += n
            stop = m.end()
            if stop >= len(text) or text[stop] not in " -./" or stop + 1 >= len(text) or not text[stop + 1].isalnum():
                break
        return (begin, stop) if digits >= 5 else None

    # --- street addresses --------------------------------------------------------------------------------------

    _HOUSE = re.compile(r"(?<![\w.:/-])\d{1,5}(?:\s?(?:bis|ter))?[a-z]?$", re.I)
    _FLAT_NO, _FLAT = re.compile(r"(?<!\w)\w{1,4}$"), re.compile(r"(?<![\w.,:/-])(?:flat|apt|unit|suite)\.?$", re.I)
    _HOUSE_RIGHT = re.compile(r"\s?(?:nº|n°|no\.?|nr\.?|,)?\s?\d{1,4}(?:[a-z]|\s[b-df-xz]|\s[aey](?=\s*(?:[,.;)\n]|$)))?(?![\w:/])(?!\.\d)", re.I)
    _NAMED_AFTER = re.compile(r"(?:(?:de la|de l['’]|des|du|de|d['’])\s?)?[^\W\d_][\w'’-]*(?:-[A-ZÉÈÀ][\w'’]*){0,3}(?: [A-ZÉÈÀ][\w'’-]*(?=[,.;\n]|$))?")
    _ONE_AFTER = re.compile(r"(?:(?:de la|de l['’]|des|du|de|d['’])\s?)?[^\W\d_][\w'’-]*", re.I)
    _BEFORE_HOUSE = re.compile(r"(?:[^\W\d_][\w.'’-]*[ ,]{1,2}){1,4}?(?=\d|n[ºo°.])", re.I)
    _CAPITAL = re.compile(r"[A-ZÄÖÜ]")

    def _house_left(self, text: str, end: int) -> int | None:
        """Begin of the house number, with the flat before it, that ends in blanks or commas at ``end``."""
        stop = end
        while stop > 0 and text[stop - 1] in " ,":
            stop -= 1
        # the number itself has at most eleven characters, one more is looked at on its left
        house = self._HOUSE.search(text, max(0, stop - 12), stop) if stop < end else None
        if not house:
            return None
        begin = house.start()
        comma = _blanks_left(text, begin)
        if comma < begin and comma and text[comma - 1] == ",":
            no = self._FLAT_NO.search(text, max(0, comma - 6), comma - 1)
            if no and (word := _blanks_left(text, no.start())) < no.start() and (flat := self._FLAT.search(text, max(0, word - 8), word)):
                return flat.start()
        return begin

    def _streets(self, text: str, low: str, by_kind: dict) -> list[tuple[int, int, str]]:
        out = []
        for start, end, _ in by_kind.get("street_after", []):
            if end < len(low) and low[end].isalnum():
                continue
            begin = self._named_left(text, low, start + 1)
            if begin is not None:
                short = low[start + 1 : end] in STREET_SHORT
                stop = end + (short and text[end : end + 1] == "." and not text[end + 1 : end + 2].isalnum())
                out.append((begin, self._tail(text, stop), "street_address"))
        for start, _, word in by_kind.get("street_mid", []):
            house = self._house_left(text, start + 1)
            if house is None:
                continue
            words = self._NAMED_AFTER.match(text, start + len(word))
            if words:
                stop = words.end()
                if low[words.start() : stop] == text[words.start() : stop]:  # in lower case only one word is the name
                    stop = self._ONE_AFTER.match(text, words.start()).end()
                out.append((house, self._tail(text, stop), "street_address"))
        for start, end, _ in by_kind.get("street_before", []):
            if start > 0 and low[start - 1].isalnum():
                continue
            m = self._BEFORE_HOUSE.match(text, end)
            if not m:
                continue
            house = self._HOUSE_RIGHT.match(text, m.end() - 1) or self._HOUSE_RIGHT.match(text, m.end())
            if house:
                out.append((start, self._tail(text, house.end()), "street_address"))
        for start, end, word in by_kind.get("street_end", []):
            begin = start
            while begin > 0 and (text[begin - 1].isalpha() or text[begin - 1] in "-'"):
                begin -= 1
            if begin == start:  # a word of its own: the name stands before it
                if text[start - 1 : start] != " " or word.strip() == "ring":
                    continue
                while begin > 1 and (_word_char(text[begin - 2]) or text[begin - 2] == "-"):
                    begin -= 1
                m = self._CAPITAL.search(text, begin - 1, start - 1)
                if not m:
                    continue
                begin = m.start()
            elif start - begin < 3:
                continue
            house = self._HOUSE_RIGHT.match(text, end - 1)
            if house and house.group().strip()[0].isdigit():
                out.append((begin, self._tail(text, house.end()), "street_address"))
        return _merged(out)

    def _named_left(self, text: str, low: str, street: int) -> int | None:
        """Begin of the house number left of at most four words of a street's name."""
        begin = street
        for _ in range(4):
            if text[begin - 1 : begin] != " " or begin < 2:
                return None
            word = begin - 1
            while word > 0 and (_word_char(text[word - 1]) or text[word - 1] in ".'’-"):
                word -= 1
            part = text[word : begin - 1]
            if not part[:1].isalpha() or part.lower() in NOT_IN_STREET or part.endswith(".") and not _SHORT_WORD.fullmatch(part):
                return None
            begin = word
            house = self._house_left(text, begin)
            if house is not None:
                return house
        return None

    def _tail(self, text: str, stop: int) -> int:
        """End of the address with its unit, floor and town."""
        for pattern in (UNIT, FLOOR):
            m = pattern.match(text, stop)
            if m:
                stop = m.end()
        m = TOWN.match(text, stop) or LOWER_TOWN.match(text, stop)
        return m.end() if m else stop

    # --- phone numbers -----------------------------------------------------------------------------------------

    _NUMBER = re.compile(r"\+?\(?\d(?:[\d]|[ .()/-](?=[\d(])|\) ?(?=\d)|[ ]\((?=\d))*")
    _EXT = re.compile(r",?\s?(?:ext\.?|extension|x|durchwahl|poste)\s?\d{1,6}\b", re.I)

    def _phones(self, text: str, low: str) -> list[tuple[int, int, str]]:
        out = []
        done = 0
        for m in self._NUMBER.finditer(text):
            if m.start() < done or len(m.group()) < LEAST_DIGITS or sum(map(str.isdigit, m.group())) < LEAST_DIGITS:
                continue
            for a, b in self._phone_parts(text, low, m.start(), m.group()):
                span = m.start() + a, m.start() + b
                ext = self._EXT.match(text, span[1])
                out.append((span[0], ext.end() if ext else span[1], "phone"))
                done = out[-1][1]
        return out

    _NO_PHONE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{2,4}|\d{1,3}(?:\.\d{1,3}){3}")
    _SHAPE = re.compile(
        r"\+\d{1,3}[ .-]?(?:\(0\)[ ]?)?\(?\d{1,5}\)?(?:[ .\-/]?\d{2,8}){1,5}"
        r"|\(\d{3,5}\) ?\d{3,4}[ .-]?\d{3,4}"
        r"|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}"
        r"|\(?0\d{1,4}\)?(?:[ /.-]?\d{2,8}){1,5}"
        r"|\d{10}"
    )
    #: The groups that the longest of these shapes has: country, zero, area and five more.
    _MOST_GROUPS = 8

    def _phone_parts(self, text: str, low: str, begin: int, run: str) -> list[tuple[int, int]]:
        """The phone numbers in the run of digits and separators at ``begin``: of the ways to cut it at its blanks, the
        one whose numbers hold most digits, then the one with fewest numbers.

        A group of a labelled or four by four grouped number begins no phone number.
        """
        starts = [0, *(i + 1 for i, ch in enumerate(run) if ch == " ")]
        ends = [*(i - 1 for i in starts[1:]), len(run)]
        labelled = _word_before(low, begin) in NOT_PHONE
        group = [re.sub(r"\D", "", run[x:y]) for x, y in zip(starts, ends, strict=True)]

        def good(i: int, j: int, fresh: bool) -> bool:
            piece = run[starts[i] : ends[j]]
            if fresh and i and (len(group[i - 1]) == len(group[i]) == 4 or labelled and " " in piece):
                return False
            return self._SHAPE.fullmatch(piece) is not None and self._is_phone(text, low, begin + starts[i], begin + ends[j])

        # best[i][fresh]: (digits, -numbers, (span, further spans)) of the groups from i on; fresh: the group before is in no number
        best: list[list[tuple]] = [[(0, 0, None)] * 2 for _ in range(len(starts) + 1)]
        for i in range(len(starts) - 1, -1, -1):
            for fresh in (False, True):
                choice = best[i + 1][True]
                for j in range(min(i + self._MOST_GROUPS, len(starts)) - 1, i - 1, -1):
                    after = best[j + 1][False]
                    score = after[0] + sum(map(len, group[i : j + 1])), after[1] - 1
                    if score > choice[:2] and good(i, j, fresh):
                        choice = (*score, ((starts[i], ends[j]), after[2]))
                best[i][fresh] = choice
        out, rest = [], best[0][True][2]
        while rest:
            out.append(rest[0])
            rest = rest[1]
        return out

    def _is_phone(self, text: str, low: str, begin: int, end: int) -> bool:
        number = text[begin:end]
        digits = re.sub(r"\D", "", number)
        before, after = text[begin - 1 : begin] if begin else "", text[end : end + 1]
        if before and (before.isalnum() or before in "_@#-./:") and not before == ":" or after and (after.isalnum() or after in "_@") or after in "-./:" and text[end + 1 : end + 2].isalnum():
            return False
        if _word_before(low, begin) in NOT_PHONE:
            label = begin
            while label > 0 and low[label - 1] in ' :"':
                label -= 1
            if not low.endswith(("phone number", "phone no", "mobile number", "tel no"), 0, label):
                return False
        if number.startswith("+"):
            return 8 <= len(digits) <= 15
        if self._NO_PHONE.fullmatch(number):
            return False
        if number.startswith(("0", "(0")):
            return 9 <= len(digits) <= 12
        if len(digits) not in (10, 11):
            return False
        if number.isdigit():
            return any(cue in low[_words_left(low, begin, CUE_WORDS) : begin] for cue in PHONE_CUES)
        return True

    # --- persons -----------------------------------------------------------------------------------------------

    _AFTER_CLOSING = re.compile(r"[ \t]*[,!.]?[ \t]*(?:\n[ \t]*)+|[ \t]*,[ \t]+")
    _FIRM_AFTER = re.compile(r"\s+&|\s+(?:und|and|et|y)\s+\w+\s+(?:%s)\b" % "|".join(map(re.escape, sorted(FIRMS))), re.I)
    _ODD_IN_LINE = re.compile(r"[^\w\s.,'’-]|\d")

    def _persons(self, text: str, low: str, by_kind: dict, taken: list) -> list[tuple[int, int, str]]:
        alone = lambda start, end, word: (start == 0 or not low[start - 1].isalnum()) and (end == len(low) or not low[end].isalpha() or word.endswith('"'))
        announced = [(end, False) for start, end, word in by_kind.get("title", []) if alone(start, end, word)]
        announced += [(end, word in WEAK_CUES) for start, end, word in by_kind.get("cue", []) if alone(start, end, word)]
        closings = [(start, word, m.end()) for start, end, word in by_kind.get("closing", []) if (start == 0 or not low[start - 1].isalnum()) and (m := self._AFTER_CLOSING.match(text, end))]
        known = self._known(text, low, by_kind)
        if not announced and not closings and not known:
            return []
        tokens = self._tokens(text, sorted(taken))
        starts = [t[0] for t in tokens]
        at = {p: i for i, p in enumerate(starts)}
        out: list[tuple[int, int, str]] = []
        for position, weak in announced:
            while position < len(text) and text[position] in " \n\t.:\"'(,":
                position += 1
            span = self._name_at(text, tokens, at[position], weak) if position in at else None
            if span:
                out.append((*span, "person_name"))
        if closings:
            lines = [-1, *(m.start() for m in re.finditer("\n", text)), len(text)]
            words = [m.start() for m in re.finditer(r"\S+", text)]
        for start, word, position in closings:
            own_line = lines[bisect_left(lines, start) - 1] + 1
            before = bisect_left(words, start) - bisect_left(words, own_line)
            if before <= (0 if word == "--" else 3):
                self._closing(text, tokens, starts, position, lines[bisect_left(lines, position)], out)
        for begin in known:
            span = self._around(text, tokens, at[begin]) if begin in at else None
            if span:
                out.append((*span, "person_name"))
        return _merged(out)

    def _known(self, text: str, low: str, by_kind: dict) -> list[int]:
        """Begins of the words that are given or family names."""
        begins = set()
        for kind in ("given", "family", "ending"):
            for start, end, _ in by_kind.get(kind, []):
                if end < len(low) and (low[end].isalpha() or low[end] == "-" and low[end + 1 : end + 2].isalpha()):
                    continue
                begin = start
                while begin > 0 and (low[begin - 1].isalpha() or low[begin - 1] in "-'" and low[begin - 2 : begin - 1].isalpha()):
                    begin -= 1
                if kind == "ending" or begin == start:
                    begins.add(begin)
        found = []
        for begin in sorted(begins):
            m = _TOKEN.match(text, begin)
            if m and (self.names.is_given(m.group()) or self.names.is_family(m.group())):
                found.append(begin)
        return found

    def _tokens(self, text: str, busy: list) -> list[tuple[int, int, str]]:
        """Words outside the spans that other kinds hold."""
        found = [(*m.span(), m.group()) for m in _TOKEN.finditer(text)]
        if not busy:
            return found
        out, k = [], 0
        for token in found:
            while k < len(busy) and busy[k][1] <= token[0]:
                k += 1
            if k == len(busy) or token[1] <= busy[k][0]:
                out.append(token)
        return out

    def _gap(self, text: str, tokens: list, i: int) -> str | None:
        """What stands between token i and the next, if they may belong to one name."""
        if i + 1 >= len(tokens) or i < 0:
            return None
        gap = text[tokens[i][1] : tokens[i + 1][0]]
        if gap in (" ", "  "):
            return " "
        if gap in (". ", ".") and len(tokens[i][2]) == 1:
            return " "
        return "," if gap == ", " else None

    def _initial(self, text: str, token: tuple) -> bool:
        return len(token[2]) == 1 and text[token[1] : token[1] + 1] == "."

    def _around(self, text: str, tokens: list, i: int) -> tuple[int, int] | None:
        """The whole name around a token that is a known given name or a family name."""
        start, end, word = tokens[i]
        given, family = self.names.is_given(word), self.names.is_family(word)
        if not given and not family:
            return None
        if self._FIRM_AFTER.match(text, end) or (left := _blanks_left(text, start)) and text[left - 1] == "&":
            return None
        following = tokens[i + 1][2].lower() if self._gap(text, tokens, i) == " " else ""
        if following in FIRMS:
            return None
        if family and not given:
            left = i
            while self._gap(text, tokens, left - 1) == " " and (tokens[left - 1][2].lower() in PARTICLES or self._initial(text, tokens[left - 1])):
                left -= 1
            if self._gap(text, tokens, left - 1) == " " and self._may_be_given(tokens[left - 1][2], word):
                left -= 1
                while self._gap(text, tokens, left - 1) == " " and (self._initial(text, tokens[left - 1]) or self.names.is_given(tokens[left - 1][2])):
                    left -= 1
            right, whole = i, None
            if self._gap(text, tokens, i) == "," and all(t[2].lower() in PARTICLES for t in tokens[left:i]):
                whole = left
                nxt = tokens[i + 1]
                if self.names.is_given(nxt[2]) or nxt[2][:1].isupper() and word[:1].isupper() and not self._common(nxt[2]) or self._initial(text, nxt):
                    right = i + 1
                    if self._gap(text, tokens, right) == " " and self._initial(text, tokens[right + 1]):
                        right += 1
            if whole is None or right == i:
                while left < i and tokens[left][2].lower() in PARTICLES:
                    left += 1
            if left == right:
                return None
            stop = tokens[right][1] + (self._initial(text, tokens[right]))
            return tokens[left][0], stop
        # a known given name
        right = i
        while self._gap(text, tokens, right) == " " and right - i < 4:
            nxt = tokens[right + 1]
            if self._initial(text, nxt) or self.names.is_family(nxt[2]) or self.names.is_given(nxt[2]) or nxt[2].lower() in PARTICLES:
                right += 1
            elif tokens[right][2].lower() in PARTICLES and right > i and nxt[2][:1].isupper():
                right += 1
            else:
                break
        while right > i and tokens[right][2].lower() in PARTICLES:
            right -= 1
        named = any(self.names.is_family(t[2]) for t in tokens[i + 1 : right + 1]) or right > i and not self._initial(text, tokens[right]) and any(t[2].lower() in PARTICLES for t in tokens[i + 1 : right])
        if named:
            return start, tokens[right][1]
        if word.lower() in ORDINARY or not word[:1].isupper() or self._gap(text, tokens, i) == " " and following in ("dashboard", "project", "pilot", "release"):
            return None
        if i > 0 and self.names.is_family(tokens[i - 1][2]) and self._gap(text, tokens, i - 1) == ",":
            return None
        if right > i and self._initial(text, tokens[right]):
            return start, tokens[right][1] + 1
        return start, end

    def _common(self, word: str) -> bool:
        return word.lower() in _COMMON

    def _may_be_given(self, word: str, family: str) -> bool:
        """May this word before a family name be its given name?"""
        if word.lower() in TITLES or word.lower() in _COMMON and not self.names.is_given(word):
            return False
        return self.names.is_given(word) or word[:1].isupper() or not family[:1].isupper() and len(word) > 2 and word.islower()

    def _name_at(self, text: str, tokens: list, i: int, weak: bool) -> tuple[int, int] | None:
        """A name where one is expected: capital words, initials and particles, or known names in any case."""
        left = i
        while tokens[left][2].lower() in TITLES and self._gap(text, tokens, left) is not None or tokens[left][2].lower() in TITLES and text[tokens[left][1] : tokens[left][1] + 2] == ". ":
            left += 1
            if left >= len(tokens):
                return None
        right = left
        words = 0
        while right < len(tokens):
            word = tokens[right][2]
            known = self.names.is_given(word) or self.names.is_family(word)
            if not (self._initial(text, tokens[right]) or known or word[:1].isupper() and not self._common(word) or words and word.lower() in PARTICLES):
                break
            words += 1
            if words >= 2 and self.names.is_family(word):
                right += 1
                break
            gap = self._gap(text, tokens, right)
            if gap == " " and words < 5:
                right += 1
            elif gap == "," and words == 1 and (self.names.is_family(word) or self.names.is_given(tokens[right + 1][2])):
                right += 1
            else:
                right += 1
                break
        right -= 1
        while right >= left and tokens[right][2].lower() in PARTICLES:
            right -= 1
        if right < left:
            return None
        following = tokens[right + 1][2].lower() if self._gap(text, tokens, right) == " " else ""
        if following in FIRMS or any(t[2].lower() in FIRMS for t in tokens[left : right + 1]) or re.match(r"\s+&", text[tokens[right][1] : tokens[right][1] + 3]):
            return None
        known = any(self.names.is_given(t[2]) or self.names.is_family(t[2]) for t in tokens[left : right + 1])
        if weak and not known and right == left:
            return None
        if weak and not any(self.names.is_family(t[2]) or self.names.is_given(t[2]) and t[2].lower() not in ORDINARY for t in tokens[left : right + 1]):
            return None
        return tokens[left][0], tokens[right][1] + (self._initial(text, tokens[right]))

    def _closing(self, text: str, tokens: list, starts: list[int], position: int, line_end: int, out: list) -> None:
        """The name under a closing: one to five words that fill the rest of the line."""
        first, beyond = bisect_left(starts, position), bisect_left(starts, line_end)
        if not 1 <= beyond - first <= 5:
            return
        line = text[position:line_end].rstrip(" .!|")
        stop = position + len(line)
        inside = [i for i in range(first, beyond) if starts[i] < stop]
        if not inside or self._ODD_IN_LINE.search(line):
            return
        words = [tokens[i][2] for i in inside]
        known = any(self.names.is_given(w) or self.names.is_family(w) for w in words)
        if known or all(w[:1].isupper() or w.lower() in PARTICLES for w in words) and not any(w.lower() in _COMMON for w in words):
            out.append((tokens[inside[0]][0], stop, "person_name"))


# Capital words that begin sentences and can't be names.
_COMMON = frozenset(
    """the a an this that these those it he she we they you i my our your his her their there here when what where which who why how if for from in on at by to as and or but not no yes so
    since although nothing some each every please send use check order invoice ticket row card version latency meeting pin user contact call text forward ship reviewer note identity account holder
    der die das ein eine wir sie er es ich wenn für gestern außerdem am im bitte zur le la les un une nous vous il elle ils je hier quand à ce si pour el los las una nosotros hoy ayer según hemos todavía no mi para
    kind best regards thanks cheers dear hello hi hallo bonjour hola re fwd subject new old can could would should session trace ref case see twice quotes colleague asked rang lives never
    monday tuesday wednesday thursday friday saturday sunday january february march july september october november december merci envíe escríbame llame team support desk""".split()
)


def _merged(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Overlapping spans of one kind as one."""
    out: list[tuple[int, int, str]] = []
    for begin, end, kind in sorted(set(spans)):
        if out and begin < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1]), kind
        else:
            out.append((begin, end, kind))
    return out


def _free(taken: list[tuple[int, int, str]], new: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """``taken`` (spans that don't overlap each other) and those of ``new`` that don't overlap it."""
    held = sorted(taken)
    starts = [t[0] for t in held]
    free = lambda n: not (i := bisect_left(starts, n[1])) or held[i - 1][1] <= n[0]
    return taken + [n for n in new if free(n)]


@lru_cache(maxsize=2)
def finder(names: tuple[tuple[str, str], ...]) -> Finder:
    """The finder for these known names, built once in a worker process."""
    return Finder(Names(names))


def findings(text: str, names: tuple[tuple[str, str], ...]) -> list[tuple[str, int, int, int]]:
    """(kind, ord, begin, end) in reading order; positions are those of ``text``."""
    return _findings(text, finder(names), default_rewriter())


def _findings(text: str, find: Finder, rewriter: Rewriter) -> list[tuple[str, int, int, int]]:
    form, source = rewriter.aligned(text)
    source.append(len(text))
    count: dict[str, int] = {}
    out = []
    for begin, end, kind in find.spans(form):
        count[kind] = count.get(kind, 0) + 1
        out.append((kind, count[kind], source[begin], source[end - 1] + 1))
    return out


def known_names(table: DataFrame, limit: int = MAX_NAMES) -> tuple[tuple[str, str], ...]:
    """The rows of a table (name_kind, name); refused if there are more than ``limit``."""
    rows = table.select("name_kind", "name").filter("name IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} known names")
    return tuple(sorted((r[0] or "", r[1]) for r in rows))


FOUND = "array<struct<kind:string,ord:int,begin:int,end:int>>"


def detect(column: Column | str, names: tuple[tuple[str, str], ...]) -> Column:
    """STRUCT(found, redacted): the findings of a text and the text with placeholders for them."""

    @F.pandas_udf(f"found {FOUND}, redacted string")
    def run(texts: pd.Series) -> pd.DataFrame:
        found, redacted = [], []
        find, rewriter = finder(names), default_rewriter()
        for text in texts:
            if not isinstance(text, str):
                found.append([])
                redacted.append(None)
                continue
            spans = _findings(text, find, rewriter)
            pieces, at = [], 0
            for kind, _, begin, end in spans:
                pieces += [text[at:begin], PLACEHOLDERS[kind]]
                at = end
            found.append([{"kind": k, "ord": o, "begin": b, "end": e} for k, o, b, e in spans])
            redacted.append("".join(pieces) + text[at:])
        return pd.DataFrame({"found": found, "redacted": redacted})

    return run(column)
