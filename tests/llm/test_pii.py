import ipaddress
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import pii

KEY = b"a key of the tests"

SAMPLE = (
    'Mr. John Smith wrote to bos.bt.42@mail8.example.com and Mrs Müller, +1 (487) 555-7209; cards 4242-4242-4242-4242 and 2852466340876421, '
    '83.229.25.121, token = "ede43f42c939b6405768150e041159052abcdef0", SSN 123-45-6789, DE89 3704 0044 0532 0130 00. Frau Hannah Иванова met г-н Иванов and Señora Ñáñez.'
)


def test_kinds():
    kinds = [(k, SAMPLE[a:b]) for a, b, k, _ in pii.find(SAMPLE)]
    assert kinds == [
        ("name", "John Smith"), ("email", "bos.bt.42@mail8.example.com"), ("name", "Müller"), ("phone", "+1 (487) 555-7209"), ("card", "4242-4242-4242-4242"), ("card", "2852466340876421"),
        ("ip", "83.229.25.121"), ("secret", "ede43f42c939b6405768150e041159052abcdef0"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"), ("name", "Hannah Иванова"), ("name", "Иванов"), ("name", "Ñáñez"),
    ]


@pytest.mark.parametrize("text", ["", "plain words only", "in 2021 about 12345 of 3.14 and 1.2.3", "version 1.2.3.4.5", "a@b", "call 555", "The Mr is here", "Dr said so", "cafés à 10:30", "999.1.1.1"])
def test_clean_texts_stay(text):
    assert pii.replace(text, KEY) == (text, [])


def test_surrogates_keep_type_and_format():
    text, pairs = pii.replace(SAMPLE, KEY)
    shape = lambda s: re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", s))
    for kind, old, new in pairs:
        assert new != old and old not in text
        if kind in ("phone", "ssn", "card", "email"):
            assert shape(old) == shape(new)
        if kind == "card":
            assert pii.luhn(re.sub(r"\D", "", old)) == pii.luhn(re.sub(r"\D", "", new))
        if kind == "ip":
            assert all(0 <= int(x) < 256 for x in new.split("."))
        if kind == "secret":
            assert re.fullmatch(r"[0-9a-f]{40}", new)
    names = {old: new for kind, old, new in pairs if kind == "name"}
    assert names["John Smith"].split()[0] in pii.GIVEN["m"] and names["Hannah Иванова"].split()[0] in pii.GIVEN["f"]
    assert re.fullmatch(r"[А-Я][а-я]+а", names["Hannah Иванова"].split()[1])  # script, case and ending stay
    assert [k for _, _, k, _ in pii.find(text)] == [k for _, _, k, _ in pii.find(SAMPLE)]


def test_keys_and_coreference():
    a = pii.surrogate("jo.x@mail1.example.com", "email", key=KEY)
    assert a == pii.surrogate("jo.x@mail1.example.com", "email", key=KEY) != pii.surrogate("jo.x@mail1.example.com", "email", key=b"other")
    assert a.split("@")[1] == pii.surrogate("other@mail1.example.com", "email", key=KEY).split("@")[1]
    assert a.lower() == pii.surrogate("JO.x@mail1.example.com", "email", key=KEY).lower()
    first = pii.surrogate("John", "name", "m", key=KEY)
    assert pii.surrogate("JOHN", "name", "m", key=KEY) == first.upper()


@given(st.sets(st.text("0123456789", min_size=4, max_size=4), min_size=2, max_size=200))
@settings(max_examples=30, deadline=None)
def test_one_to_one(values):
    assert len({pii.permute_text(v, KEY, "x") for v in values}) == len(values)


def test_one_to_one_over_all_short_numbers_and_names():
    assert len({pii.permute_text(f"{i:04d}", KEY, "t") for i in range(10_000)}) == 10_000
    names = sorted({*pii.GIVEN["m"], *pii.GIVEN["f"], *("".join((a, b, c, d)) for a in "KLM" for b in "aeiou" for c in "rst" for d in "aeno")})
    assert len({pii.new_name(n, KEY) for n in names}) == len(names)
    good = [f"{i:012d}" for i in range(5000) if pii.luhn(f"{i:012d}")]
    assert len({pii.surrogate(g, "card", key=KEY) for g in good}) == len(good)


def test_tables(make_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows] + [(50, SAMPLE), (51, SAMPLE), (52, "x" * 100_000 + " a.b@c.example.com")]
    docs = make_docs(rows, extra=True)
    out = pii.replace_pii(docs, KEY)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and got[50].text == got[51].text == pii.replace(SAMPLE, KEY)[0] and got[50].n_entities == 13 and got[50].kinds == "card,email,iban,ip,name,phone,secret,ssn"
    assert got[1].text is None and got[1].n_entities == 0 and got[4].text == odd_rows[3][1] and got[52].n_entities == 1
    assert pii.collisions(out).count() == 0
    again = pii.anonymise(docs, KEY)
    assert again.dtypes == docs.dtypes and {r.doc_id: r.text for r in again.collect()}[50] == got[50].text
    assert pii.replace_pii(make_docs([]), KEY).count() == 0 and pii.anonymise(make_docs([]), KEY).count() == 0


@pytest.mark.parametrize("first", ["Mr John Smith", "Mr. Smith", "Mr J. R. Smith", "Mr Smith's clerk for John"])
def test_later_and_untitled_mentions_of_a_name(first):
    text = f"Before it, Smith came. {first} wrote. Smith said, SMITH's view; John Smith signed, blacksmith and smith and Smithson stay."
    new, pairs = pii.replace(text, KEY)
    assert not re.search(r"\b(?:Smith|SMITH|John)\b", new) and new.endswith("blacksmith and smith and Smithson stay.")
    family = pii.surrogate("Smith", "name", key=KEY)
    assert f"Before it, {family} came." in new and f"{family} said, {family.upper()}'s view; {pii.surrogate('John Smith', 'name', key=KEY)} signed" in new
    assert all(k == "name" for k, _, _ in pairs)


def test_a_word_of_a_name_has_one_surrogate():
    (_, _, lone), (_, _, full), (_, _, given) = pii.replace("Mr Smith met Mr John Smith and Mr John.", KEY)[1]
    assert full == f"{given} {lone}" and given in pii.GIVEN["m"]
    assert pii.surrogate("Wolfgang Smith", "name", key=KEY).split() == [pii.surrogate("Wolfgang", "name", key=KEY), lone]
    new, pairs = pii.replace("Mr John Smith\nSmith Report", KEY)
    assert "Smith" not in new and len(pairs) == 2
    new, pairs = pii.replace("Dr 王小明，来了。昨天王小明说。", KEY)
    assert "王小明" not in new and len({s for _, _, s in pairs}) == 1


PHONES = ["+14155550123", "+33 1 23 45 67 89", "06 12 34 56 78", "06.12.34.56.78", "+49 30 12345678", "030 12345678", "(030) 1234567", "0171/1234567", "044 668 18 00", "0612345678", "+44 (0)20 7946 0958", "0033 6 12 34 56 78", "+290 2345", "+1 (487) 555-7209"]
IPV6 = ["2001:db8::1", "2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "fe80::1ff:fe23:4567:890a", "::ffff:192.0.2.128", "2001:db8::"]


@pytest.mark.parametrize("kind, value", [*(("phone", v) for v in PHONES), *(("ipv6", v) for v in IPV6)])
def test_forms_of_phones_and_addresses(kind, value):
    text = f"Reach {value}, or ({value}): at {value}. Then go."
    new, pairs = pii.replace(text, KEY)
    assert [(k, v) for k, v, _ in pairs] == [(kind, value)] * 3 and value not in new and len({s for _, _, s in pairs}) == 1
    out = pairs[0][2]
    assert [(text[a:b], k) for text in [f"x {out} y"] for a, b, k, _ in pii.find(text)] == [(out, kind)]
    if kind == "phone":
        assert re.sub(r"\d", "0", out) == re.sub(r"\d", "0", value)


@pytest.mark.parametrize(
    "text",
    ["on 01.02.2021 at 10:30", "2021-05-06 07:08:09", "10:30:45", "std::vector and ::add or a :: b", "00:1a:2b:3c:4d:5e", "12345678 or 1234567890", "3.14159265 and 0.12345678", "+1000000 points, +5 and +12 %", "01/02/2021", "ids 0000012345", "10 20 30 40 50 60", "1,000,000 and 12 345", "1:2:3", "code 01 02 03 04 05 06 07"],
)
def test_clean_numbers_stay(text):
    assert pii.replace(text, KEY) == (text, [])


def test_spellings_of_a_number_or_address_share_a_surrogate():
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(pii.surrogate("+14875557209", "phone", key=KEY)) == digits(pii.surrogate("+1 (487) 555-7209", "phone", key=KEY))
    a, b = (ipaddress.IPv6Address(pii.surrogate(v, "ipv6", key=KEY)) for v in ("2001:db8::1", "2001:0DB8:0:0:0:0:0:1"))
    assert a == b
    assert len({pii.surrogate(f"2001:db8::{i:x}", "ipv6", key=KEY) for i in range(1, 3000)}) == 2999
    assert len({pii.surrogate(f"+3310000{i:04d}", "phone", key=KEY) for i in range(10_000)}) == 10_000


def test_no_value_is_its_own_surrogate():
    assert all(pii.permute([i, j], [3, 2], KEY, "t") != [i, j] for i in range(3) for j in range(2))
    assert len({tuple(pii.permute([i, j], [3, 2], KEY, "t")) for i in range(3) for j in range(2)}) == 6
    assert all(pii.permute_text(f"{i:03d}", KEY, "t") != f"{i:03d}" for i in range(1000))
    for text in ("Mr Ё", "Mr Żółć", "Mr สมชาย", "Dr Łukasz Ñ", "Frau Þóra Ærø", "Mr İpek", "Dr Ἀχιλλεύς", "Dr مُحَمَّد", "Mr X"):
        new, pairs = pii.replace(text, KEY)
        assert len(pairs) == 1 and pairs[0][1] == text.split(" ", 1)[1] and new != text
        if len(pairs[0][1]) > 3:
            assert sum(a != b for a, b in zip(pairs[0][1], pairs[0][2])) * 4 >= len(pairs[0][1])
    assert pii.surrogate("--", "secret", key=KEY) != "--"


def test_given_names_go_by_gender_and_family_names_do_not():
    _, pairs = pii.replace("Mr Alex Kim and Ms Alex Kim met Mr Kim.", KEY)
    (_, _, he), (_, _, she), (_, _, lone) = pairs
    assert he.split()[0] != she.split()[0] and he.split()[1] == she.split()[1] == lone
    new, pairs = pii.replace("Ms Alex Kim came; Alex left. Alex Kim, Dr Alex Kim.", KEY)
    assert len({w for _, _, s in pairs for w in s.split()}) == 2 and "Alex" not in new


def test_check_digits_of_accounts():
    good = "DE89370400440532013000"
    assert pii.iban_check(good[:2], good[4:]) == good[2:4]
    new = pii.surrogate(good, "iban", key=KEY)
    assert pii.iban_check(new[:2], new[4:]) == new[2:4] and new != good and new[:2] == "DE"
    bad = "DE88 3704 0044 0532 0130 00"
    out = pii.surrogate(bad, "iban", key=KEY).replace(" ", "")
    assert pii.iban_check(out[:2], out[4:]) != out[2:4]


def test_query_against_brute_force(spark, make_docs):
    """What lies outside entities stays; surrogates are equal where values are, and put back they give the text."""
    import random

    rng = random.Random(8)
    some = ["Mr John Smith", "Mrs Ada Smith", "Smith", "a.b@c3.example.com", "A.B@c3.example.com", "+1 (487) 555-7209", "10.2.3.4", "123-45-6789", "4242-4242-4242-4242", "2001:db8::7"]
    rows = [(i, " and ".join(rng.choice(["plain", "words", f"n{i}@x.example.org", *some]) for _ in range(12))) for i in range(60)]
    texts = dict(rows)
    values: dict = {}
    for r in pii.checked(pii.replace_pii(make_docs(rows).repartition(5), KEY)).collect():
        at, back = 0, []
        old, new = texts[r.doc_id], r.text
        for e in r.entities:
            gap = new.index(e.surrogate, at) - at
            back += [new[at : at + gap], e.value]
            at += gap + len(e.surrogate)
            if e.kind != "name":
                values.setdefault((e.kind, e.value.lower()), set()).add(e.surrogate.lower())
        assert "".join([*back, new[at:]]) == old and r.n_entities == len(r.entities)
        for value in re.findall(r"[\w.]+@[\w.]+|\+1 [() \d-]+|\d+-\d+-[\d-]+|10\.2\.3\.4|2001:\S+|Smith|John", old):
            assert value not in new
    assert all(len(v) == 1 for v in values.values()) and len({(k, *v) for (k, _), v in values.items()}) == len(values)


def test_an_error_where_two_values_share_a_surrogate(spark):
    rows = [(1, [("ip", "1.1.1.1", "2.2.2.2")]), (2, [("ip", "1.1.1.2", "2.2.2.2")])]
    with pytest.raises(ValueError, match="share a surrogate"):
        pii.checked(spark.createDataFrame(rows, "doc_id long, entities array<struct<kind:string,value:string,surrogate:string>>"))
