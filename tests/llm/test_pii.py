import random
import re
import time

from yardstats.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_base_kinds_are_the_patterns_matches():
    pick, find = random.Random(5), pii.span_finder()
    for turn in range(60_000):
        letters = "a@.1 +-(_0259é:/@.@.12" if turn % 3 else "0123456789 -.+"
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 50)))
        assert [s for s in find(text) if s[0] in pii.BASE_KINDS] == _base(text), text


def test_added_kinds():
    find = pii.span_finder()
    text = "IBAN: DE89 3704 0044 0532 0130 00, see https://joe:pw@host.org/x?y account no. 12345678."
    assert [(k, text[a:b]) for k, a, b in find(text)] == [
        ("account", "DE89 3704 0044 0532 0130 00"), ("url", "https://joe:pw@host.org/x?y"), ("email", "pw@host.org"),
        ("account", "12345678"),
    ]
    for clean in ("IBAN: DE88 3704 0044 0532 0130 00", "on account of 5 things", "https://host.org/x@y", "accounts 123456"):
        assert [s for s in find(clean) if s[0] in ("url", "account")] == []


def test_long_runs_stay_linear():
    find = pii.span_finder()
    for piece in ("1", "a", "1.", "@", "+1", "1 ", "a@a", "://", "account 1", "+1("):
        started = time.time()
        find(piece * (400_000 // len(piece)))
        assert time.time() - started < 8, piece


def test_rows(rows):
    data = [(1, "é a@b.cd 1.2.3.4", 5, "x"), (1, "é a@b.cd 1.2.3.4", 5, "x"), (None, None, None, "y"), (2, "", 0, "z")]
    docs = rows(data, "doc_id long, text string, n_chars long, spans string")
    found = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find_personal_data(docs).collect()]
    assert sorted(found, key=str) == sorted(
        [(1, [("email", 2, 8), ("ip", 9, 16)])] * 2 + [(None, []), (2, [])], key=str
    )
    masked = pii.mask_personal_data(docs)
    assert masked.columns == docs.columns
    assert {tuple(r) for r in masked.collect()} == {
        (1, "é [EMAIL] [IP]", 14, "x"), (None, None, None, "y"), (2, "", 0, "z")
    }
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_ibans_before_capitals_and_without_a_cue():
    find = pii.span_finder()
    iban = "DE89 3704 0044 0532 0130 00"
    for text in (f"IBAN: {iban} BIC COBADEFF", f"pay to {iban} BIC COBADEFF", f"{iban}", f"({iban.replace(' ', '')})", f"to {iban} AND TO 12"):
        assert [text[a:b] for kind, a, b in find(text) if kind == "account"] in ([iban], [iban.replace(" ", "")])
    for clean in ("pay to DE88 3704 0044 0532 0130 00 BIC COBADEFF", f"X{iban}", "AB12 34"):
        assert [s for s in find(clean) if s[0] == "account"] == []
