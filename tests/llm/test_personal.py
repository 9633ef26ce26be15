"""Personal data: what counts, what doesn't, and that the rest of the text stays."""

import pytest

from tidemark.llm import personal as P

NAMES = tuple(
    [("given", n) for n in "Amina April Rose Luca Núria Zoë May Grace Paavo Emeka".split()]
    + [("family", n) for n in "Kelaro Kelvik Kelmere Tolaro Tolvik Tolmere Quarlock Quarvik Quarmere Dallock Dalvik Dalaro".split()]
    + [("family", "de la Torvane")]
)


def found(text):
    return [(k, text[b:e]) for k, _, b, e in P.findings(text, NAMES)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("write to a.b+c@mail.dot.test.", [("email", "a.b+c@mail.dot.test")]),
        ("mail luca96 at mail dot ostrel dot invalid now", [("email", "luca96 at mail dot ostrel dot invalid")]),
        ("to zeno63[at]kelp.example, x @ y.test and q (at) z (dot) org", [("email", "zeno63[at]kelp.example"), ("email", "x @ y.test"), ("email", "q (at) z (dot) org")]),
        ("tariq dot dalo at bay dot test", [("email", "tariq dot dalo at bay dot test")]),
        ("build kit@13.40.14, @cached_reply, meet at noon", []),
        ("Call +61 491 570 741 or 030/23125712, (901) 555-0140", [("phone", "+61 491 570 741"), ("phone", "030/23125712"), ("phone", "(901) 555-0140")]),
        ("on 383 555 0145 ext. 4 after 7", [("phone", "383 555 0145 ext. 4")]),
        ("+49 (0)30 23125 367 / 07700 900693 / 415.555.0179", [("phone", "+49 (0)30 23125 367"), ("phone", "07700 900693"), ("phone", "415.555.0179")]),
        ("Invoice 2364 3085 1132, item 530-20-3174, Ticket 3780-18-5895, 2026-04-18, 10.58.0.62, +207 441, request 3079581516, SKU 9114-5831-16, 12:21:18", []),
        ("SSN 743657844 into", [("id_number", "743657844")]),
        ("NI number PW 48 15 79 A into the", [("id_number", "PW 48 15 79 A")]),
        ("driver's licence WJ-3162-8868. Me", [("id_number", "WJ-3162-8868")]),
        ("Steuer-ID 81 970 725 613 is, passport no. G70444403, DNI 87431632P", [("id_number", "81 970 725 613"), ("id_number", "G70444403"), ("id_number", "87431632P")]),
        ("needs a licence. (see M2H7U813)", []),
        ("lives at 1616 Lantern St., Apt 22A, Halvik 42448 and", [("street_address", "1616 Lantern St., Apt 22A, Halvik 42448")]),
        ("Ship to: Flat 23, 57 Copper Row, Halvik\nnext", [("street_address", "Flat 23, 57 Copper Row, Halvik")]),
        ("to Calle Heron 55, 5º D instead; in der heronallee 56; 111 rue des Lantern, Halvik", [("street_address", "Calle Heron 55, 5º D"), ("street_address", "heronallee 56"), ("street_address", "111 rue des Lantern, Halvik")]),
        ("The street view tool returned 22 results for the north road test set. The Fennel Road dataset.", []),
        ("My colleague paavo quarlock, Amina R. Kelvik and Sanna de la Torvane", [("person_name", "paavo quarlock"), ("person_name", "Amina R. Kelvik"), ("person_name", "Sanna de la Torvane")]),
        ("asked Kelaro, Amina and L. Tolvik", [("person_name", "Kelaro, Amina"), ("person_name", "L. Tolvik")]),
        ("Best regards,\nMark Dallow", [("person_name", "Mark Dallow")]),
        ("cheers, Will", [("person_name", "Will")]),
        ("Thanks,\nJomar\n", [("person_name", "Jomar")]),
        ("until May, in April, the Rose dashboard; Will the cap hold, and may we? Tolaro & Hesker Holdings", []),
        ("Dr. Quarmere rang", [("person_name", "Quarmere")]),
        ("", []),
    ],
)
def test_findings(text, expected):
    assert found(text) == expected


def test_spelled_with_other_characters():
    text = "ｃａｌｌ ｋｃ@ｎｉｍｂｕｓ．ｔｅｓｔ or 0​7700 900⁠693, Аmina Kelvik"
    assert [k for k, _ in found(text)] == ["email", "phone", "person_name"]


def test_only_the_findings_are_replaced(spark):
    rows = [(1, "SSN 743657844, mail a@b.test; a@b.test again"), (2, None), (3, ""), (4, "word " * 50_000 + "a@b.test"), (5, "<redacted> nothing")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.d for r in df.select("id", P.detect("text", NAMES).alias("d")).collect()}
    assert got[1].redacted == "SSN <ID_NUMBER>, mail <EMAIL>; <EMAIL> again"
    assert [(f.kind, f.ord) for f in got[1].found] == [("id_number", 1), ("email", 1), ("email", 2)]
    assert got[2].redacted is None and got[2].found == [] and got[3].redacted == ""
    assert got[4].redacted == "word " * 50_000 + "<EMAIL>" and got[5].redacted == "<redacted> nothing"


def test_a_list_of_names_beyond_the_bound_is_refused(spark):
    table = spark.createDataFrame([("given", f"n{i}") for i in range(5)] + [("given", None), (None, "x")], "name_kind string, name string")
    assert len(P.known_names(table)) == 6
    with pytest.raises(ValueError):
        P.known_names(table, 3)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("call 415-555-0100 415-555-0199 now", ["415-555-0100", "415-555-0199"]),
        ("tel 0171 2345678 0172 3456789", ["0171 2345678", "0172 3456789"]),
        ("suite 12 415-555-0100", ["415-555-0100"]),
        ("9 020 7946 0123 or", ["020 7946 0123"]),
        ("+49 30 1234567 0171 2345678", ["+49 30 1234567", "0171 2345678"]),
        ("card 4000 0012 3456 7899, ticket 12 345 678 9012", []),
    ],
)
def test_every_number_of_a_run(text, expected):
    assert [v for k, v in found(text) if k == "phone"] == expected
