"""Personal information that no other text of the document announces."""

import pytest

from kindred.llm import personal

KNOWN = {"maria": "given", "jonas": "given", "keller": "family", "lopez": "family"}


def found(text):
    return [(k, text[a:b]) for a, b, k in personal.find_personal(text, KNOWN)]


@pytest.mark.parametrize("text", ["name@host [dot] org", "name @host.org", "name [Arroba] host.org", "name@host DOT org"])
def test_each_disguise_alone(text):
    assert found(f"see {text} for it") == [("email", text)]


@pytest.mark.parametrize("number", ["zero-six-one-two-three-four-five", "zero, six, one, two, three, four, five"])
def test_spelled_digits_with_any_separator(number):
    assert found(f"call me on {number}.") == [("phone", number)]


@pytest.mark.parametrize("name", ["J. Keller", "j. p. keller", "A. de la Lopez", "Maria Quint", "Jonas T. van Quint", "Jonas Lopez"])
def test_names_without_a_phrase(name):
    assert found(f"yesterday {name} came by") == [("name", name)]


@pytest.mark.parametrize("text", ["J. Keller Server", "Maria Street", "then Maria came", "dear Keller", "Maria, Monday is fine", "e.g. keller"])
def test_no_names(text):
    assert found(text) == []


# Written by hand; none of it stands in the documents.
HELD_OUT = [
    ("write to john dot doe at gmail dot com today", "email", "john dot doe at gmail dot com"),
    ("it is john.doe at gmail.com", "email", "john.doe at gmail.com"),
    ("mail ana_1@post.example!", "email", "ana_1@post.example"),
    ("my address: lee at example.org", "email", "lee at example.org"),
    ("My colleague Tomasz Kowalczyk fixed it", "name", "Tomasz Kowalczyk"),
    ("Written by Tomasz Kowalczyk", "name", "Tomasz Kowalczyk"),
    ("Yours truly,\nOluwaseun Adeyemi", "name", "Oluwaseun Adeyemi"),
    ("Please ask Priya Raghunathan about it", "name", "Priya Raghunathan"),
    ("mein Kollege Jürgen von Brandt weiß es", "name", "Jürgen von Brandt"),
    ("Many thanks,\n\nMei-Ling O’Hara", "name", "Mei-Ling O’Hara"),
    ("at 42 Martin Luther King Boulevard", "street_address", "42 Martin Luther King Boulevard"),
    ("we moved to 10 Old Mill Lane", "street_address", "10 Old Mill Lane"),
    ("wohnt in der Karl-Marx-Allee 12b", "street_address", "Karl-Marx-Allee 12b"),
    ("reach me: 555 0134 2222", "phone", "555 0134 2222"),
    ("Ring me on 020 7946 0958", "phone", "020 7946 0958"),
    ("dial +1 555 0100 199 now", "phone", "+1 555 0100 199"),
]
NOTHING = [
    "look at example.com", "caused by Difudor Studio", "Fixed by Database Migration", "we met at noon", "version 10.20.30 at 12:30", "5 Open Requests", "took 120 ms, 340 ms and 560 ms",
    "blocked by Connection Pooling", "see the dot at the end", "order 123456789 shipped",
]


def test_held_out_cases():
    hits = sum((kind, passage) in found(text) for text, kind, passage in HELD_OUT)
    every = sum(len(found(text)) for text, _, _ in HELD_OUT) + sum(len(found(text)) for text in NOTHING)
    assert hits / len(HELD_OUT) >= 0.9 and hits / every >= 0.9


def test_no_window_cuts_a_passage():
    local = "a" * 300 + "@example.org"
    street = "Lang" * 60 + "straße 5"
    name = "A" + "b" * 150 + " C" + "d" * 150
    assert found(f"see {local} now") == [("email", local)]
    assert found(f"in der {street}") == [("street_address", street)]
    assert found(f"then {name} wrote: x") == [("name", name)]
