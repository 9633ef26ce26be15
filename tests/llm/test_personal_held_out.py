"""Texts by other templates than those of the test tables: what is marked must be found, and nothing else."""

import re
import time

import pytest

from tidemark.llm import personal as P

NAMES = tuple(
    sorted(
        [("given", n) for n in "Olivia Noah Hannah Lukas Camille Mateo Lucía Priya Omar Ingrid Theo Zoé".split()]
        + [("family", n) for n in "Whitfield Okafor Brandstetter Lindqvist Moreau Castellanos Iyer Haddad Novák Fairbanks".split()]
    )
)
MARK = re.compile(r"\[\[(email|phone|id_number|street_address|person_name):(.*?)\]\]", re.S)
TEXTS = [
    "Would you kindly forward the minutes to [[email:olivia.w+board@riverside-clinic.org]] before noon?",
    "Two inboxes bounced: [[email:ops@kite.io]] and [[email:n.okafor@mail.kite.co.uk]].",
    "mail me under [[email:hannah (at) brandstetter (dot) at]], the form is broken",
    "I can be found at [[email:theo dot fairbanks at harbor dot net]] most days.",
    "cc=<[[email:Team.Lead_7@example-firm.museum]]>;subject=late",
    "The landlord only answers on [[phone:+1 (212) 555-0187]] after six.",
    "Rufen Sie mich bitte unter [[phone:+49 30 901820]] zurück.",
    "Son portable : [[phone:06 12 34 56 78]], laissez un message.",
    "Her mobile, [[phone:(415) 555-0132]], went straight to voicemail.",
    "Kontaktnummer [[phone:0171/2345678]] oder per Fax [[phone:0171/2345679]].",
    "Llámame al [[phone:+34 612 345 678]] si llegas tarde.",
    "Dial [[phone:555-867-5309]] and ask about the boiler.",
    "The desk line is [[phone:+44 20 7946 0321]]; the old one was [[phone:020 7946 0999]].",
    "She typed her social security number as [[id_number:078-05-1120]] into the chat.",
    "Passport [[id_number:X4729183]] expires in May, the copy is attached.",
    "My driver's licence number is [[id_number:D1234567]] and it was stolen.",
    "National Insurance: [[id_number:QQ 12 34 56 C]] was already on the payslip.",
    "Die Steuer-ID lautet [[id_number:12 345 678 901]], bitte im Portal eintragen.",
    "Aadhaar no. [[id_number:4987 6543 2109]] was typed twice.",
    "Mi DNI es [[id_number:12345678Z]] y ya lo envié ayer.",
    "Personalausweis Nr. [[id_number:L01X00T47]] liegt als Kopie bei.",
    "Deliver the crate to [[street_address:48 Juniper Lane]] and ring twice.",
    "We moved from [[street_address:9 Old Mill Road]] to [[street_address:1200 West Harbor Boulevard, Suite 4]] in spring.",
    "Die Wohnung in der [[street_address:Lindenstraße 17]] ist noch frei.",
    "Le colis attend au [[street_address:14 rue des Lilas]] depuis mardi.",
    "Quedamos en la [[street_address:Calle Mayor 23]] a las ocho.",
    "The parcel for [[street_address:77b Station Road, Leeds]] came back.",
    "Treffpunkt: [[street_address:Am Mühlweg 5]], hinterer Eingang.",
    "Yesterday [[person_name:Olivia Whitfield]] closed the account herself.",
    "The reply came from [[person_name:Dr. Priya Iyer]], not from the robot.",
    "[[person_name:Lukas Brandstetter]] und [[person_name:Ingrid Lindqvist]] waren beide dabei.",
    "On the form it says [[person_name:Moreau, Camille]] in capital letters.",
    "Best wishes to [[person_name:Mateo Castellanos]] and his team.",
    "Nobody told [[person_name:Omar Haddad]] that the queue was closed.",
    "Bonjour [[person_name:Zoé Moreau]], votre dossier est complet.",
    "Please thank [[person_name:Hannah]] for the cake.",
    "The note was signed by [[person_name:J. Fairbanks]] on Friday.",
    "Sincerely,\n[[person_name:Noah Okafor]]",
    "Estimada [[person_name:Lucía Castellanos]]: adjuntamos la copia.",
    "mr [[person_name:novák]] called again about the meter",
    "Our colleague [[person_name:Theo Novák]] will take over from [[person_name:Olivia]].",
    # what isn't personal data
    "Order 4512-8891-0034 left the hall at 10:45 with 12 crates.",
    "The build 2024.11.03 took 415 s, see ticket 5550187 and commit 9f8e7d6c5b4a.",
    "Server 10.20.30.40 answered in 78 ms after 1200 retries.",
    "Invoice number 20240911-77 over 1,234.50 EUR is due on 2024-10-01.",
    "Card 4111 1111 1111 1111 was declined at terminal 00482.",
    "The street was quiet, the road dry, and the avenue empty.",
    "Whitfield & Moreau Partners filed the annual report.",
    "Will may grant hope in april, said the summer issue.",
]


def parts(marked: str) -> tuple[str, set[tuple[str, str]]]:
    return MARK.sub(lambda m: m.group(2), marked), {(m.group(1), m.group(2)) for m in MARK.finditer(marked)}


def test_recall_and_precision_on_texts_of_other_templates():
    wanted = found = both = 0
    missed, extra = [], []
    for marked in TEXTS:
        text, want = parts(marked)
        got = {(kind, text[a:b]) for kind, _, a, b in P.findings(text, NAMES)}
        bare = lambda rows: {(k, t.removeprefix("Dr. ").strip(" .")) for k, t in rows}
        got, want = bare(got), bare(want)
        wanted, found, both = wanted + len(want), found + len(got), both + len(got & want)
        missed += want - got
        extra += got - want
    print(f"recall {both / wanted:.3f} of {wanted}, precision {both / found:.3f} of {found}; missed {missed}; extra {extra}")
    assert both / wanted >= 0.9 and both / found >= 0.9


@pytest.mark.parametrize("size", [90, 300, 5000])
def test_long_local_parts_are_found_whole(size):
    text = "x " + "a" * size + "@example.com y"
    assert [(a, b) for kind, _, a, b in P.findings(text, NAMES)] == [(2, size + 14)]
    spelled = "write to " + "ab dot " * size + "smith at example dot com today"
    assert [(a, b) for kind, _, a, b in P.findings(spelled, NAMES) if kind == "email"] == [(9, len(spelled) - 6)]


def test_cues_blanks_and_words_of_any_length():
    number = lambda text: [text[a:b] for kind, _, a, b in P.findings(text, NAMES) if kind == "id_number"]
    assert number("passport number is on file for the code: number:  " + " " * 200 + "X4729183 ok") == ["X4729183"]
    street = lambda text: [text[a:b] for kind, _, a, b in P.findings(text, NAMES) if kind == "street_address"]
    long = "Q" + "u" * 200
    assert street(f"at 12{' ' * 60}{long} Street and on") == [f"12{' ' * 60}{long} Street"]
    assert street(f"Alte {'X' + 'y' * 90}er Straße 5 liegt") == [f"{'X' + 'y' * 90}er Straße 5"]
    phone = lambda text: [text[a:b] for kind, _, a, b in P.findings(text, NAMES) if kind == "phone"]
    assert phone("invoice" + " " * 100 + "0171 2345678") == []


@pytest.mark.parametrize("unit", ["Best regards,\nAnna Meyer\n", "thanks, Olivia Moreau, ", "12 Juniper Lane, ", "passport number ", "n.o@kite.io ", "415-555-0100 ", "a@", "hi Noah "])
def test_time_grows_with_the_text(unit):
    def seconds(size: int) -> float:
        text = unit * (size // len(unit))
        began = time.process_time()
        P.findings(text, NAMES)
        return time.process_time() - began

    seconds(10_000)
    small, large = seconds(100_000), seconds(800_000)
    assert large < 20 * max(small, 0.02)
