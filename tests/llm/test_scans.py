import base64
import hashlib
import json
import random
import re

import duckdb
import pandas
import pytest

from geolith.llm import licenses, pii, secret_scan

NOTICES = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.",
    "apache  LICENSE and CC BY-NC 4.0; cc by",
    "This work is licensed under the GNU General Public License, version 3.",
    "this work, which is licensed under the good old gnu general public license version 3",
    "mit license mit license mit",
    "gnu general public",
    "licensed under the",
    "",
    None,
    "...mit license",
    "MIT Licenſe, mit licenKe",
]


def edited(text):
    """A whole text with some words changed, lost and inserted."""
    w = text.split()
    for at in range(len(w) - 10, 10, -23):
        w[at : at + 1] = ([], ["other"], [w[at], "very", "more"])[at % 3]
    return "see below " + " ".join(w) + " end"


def shuffled(text):
    """The same grams of four words in another order, which is no copy."""
    w = text.split()
    parts = [w[k : k + 5] for k in range(0, len(w), 5)]
    return " ".join(" ".join(p) for p in parts[::-1])


NOTICES += [edited(t) for t in licenses.TEXTS] + [shuffled(t) for t in licenses.TEXTS]


def test_licenses_match_sql(spark):
    rows = [(k, t) for k, t in enumerate(NOTICES)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(licenses.sql()).df()
    columns = sorted(want.columns)
    value = lambda v: None if pandas.isna(v) else v if isinstance(v, str) else float(v)
    plain = lambda f: sorted(repr([value(v) for v in r]) for r in f[columns].astype(object).itertuples(index=False))
    assert repr(plain(got)) == repr(plain(want))
    by_id = got.set_index("doc_id")
    assert by_id.loc[0, "labels"] == "mit,mit-notice" and by_id.loc[1, "base_labels"] == "apache"
    whole = {label: k for k, label in enumerate(licenses.TEXTS.values(), len(NOTICES) - 2 * len(licenses.TEXTS))}
    for label, k in whole.items():
        assert label in by_id.loc[k, "labels"].split(",") and f"{label}:2:" in by_id.loc[k, "spans"]
        assert label not in by_id.loc[k + len(licenses.TEXTS), "labels"].split(",")
    assert "gpl-3.0" in by_id.loc[4, "labels"] and by_id.loc[5, "n_base"] == 2 and by_id.loc[6, "labels"] == ""


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0"), *[der(2, bytes([7]) * k) for k in (64, 3, 64, 32, 32, 32, 32, 32)])
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, b"\x2a\x03\x04"), der(5)), der(4, bytes(range(48))))
SEC1 = der(0x30, der(2, b"\1"), der(4, bytes(range(32))))


def b64url(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


TOKEN = ".".join([b64url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64url(b'{"sub":"42"}'), b64url(bytes(range(32)))])


@pytest.mark.parametrize("key", [RSA, PKCS8, SEC1])
def test_keys_are_confirmed(key):
    for said in (base64.b64encode(key).decode(), key.hex()):
        text = f"before {said} after"
        assert ("key", 7, 7 + len(said)) in secret_scan.find(text)[1]
        spoiled = base64.b64encode(key[:-1]).decode() if said[0] != key.hex()[0] else key[:-1].hex()
        assert not any(k == "key" for k, _, _ in secret_scan.find(f"x {spoiled} y")[1])
    armoured = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END PRIVATE KEY-----"
    assert ("key", 2, 2 + len(armoured)) in secret_scan.find("a " + armoured)[1]


def test_tokens_are_confirmed():
    assert secret_scan.find(f"é {TOKEN}.")[1] == [("token", 2, 2 + len(TOKEN))]
    assert secret_scan.find("abcdefgh.ijklmnop.qrstuvwx and " + b64url(b"{}" * 20) + ".abcd.efgh")[1] == []


def base(text):
    found = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_short_tokens_and_wrapped_keys_need_no_neighbours():
    import base64
    import textwrap

    short = b64url(b'{"alg":"none"}') + "." + b64url(b'{"sub":"42"}') + "."
    assert len(short) < 40 and secret_scan.find(f"a {short} b")[1] == [("token", 2, 2 + len(short))]
    number = b"\x02\x82\x00\xc8" + b"\x11" * 200
    body = b"\x02\x01\x00" + number * 8
    key = b"\x30\x82" + len(body).to_bytes(2, "big") + body
    for more in (key, key[:-4]):
        lines = "\n".join(textwrap.wrap(base64.b64encode(more).decode(), 64))
        found = [s for s in secret_scan.find(f"it is\n{lines}\nand more")[1] if s[0] == "key"]
        assert found == ([("key", 6, 6 + len(lines))] if more == key else [])
    whole = base64.b64encode(key).decode()
    width = next(w for w in range(40, len(whole) // 2) if len(whole) % w == 0)
    lines = "\n".join(textwrap.wrap(whole, width))
    assert [s for s in secret_scan.find(f"{lines}\ndone")[1] if s[0] == "key"] == [("key", 0, len(lines))]


def test_secret_patterns_match_plain_search(spark):
    rng = random.Random(1)
    pieces = ["token = \"" + "ab12" * 10 + '"', "PassWord: hunter2x", "apikey=short", "AKIA" + "A1" * 10, "secret=token=abcdef", "word", "é", "0f" * 11, "0f" * 12, "api_Key : 'x", "toKen=abcdefg"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    got = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        want = base(t)
        assert got[k]["spans"] == secret_scan.joined(want)
        assert got[k]["base_sha256"] == hashlib.sha256(secret_scan.joined(want).encode()).hexdigest()
        assert got[k]["n_hex"] == sum(s[0] == "hex" for s in want)


def plain_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_patterns_match_plain_search():
    rng = random.Random(2)
    pieces = ["a.b+c@d-e.com", "x@y", "@@a@b.c.d@e.f", "1.2.3.4", "256.1.1.1", "001.002.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (234) 567-8901", "+1 23", "und", "é@é.com", "a@b.c_d@e.ff", "12-34"]
    for _ in range(400):
        text = rng.choice([" ", "", ", "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == plain_pii(text)


def test_similar_tokens_share_a_label():
    w = pii.trained()
    text = "call +1 (487) 555-7209 soon or 14875557209 then pay 4736962573099581 not 4736962573099582 to x.90@mail2.example.com or x.90@mail2 in 2024 for 300"
    base, every = pii.find(text, w)
    said = {(k, text[s:e]) for k, s, e in set(every) - set(base)}
    assert said == {("phone", "14875557209"), ("card", "4736962573099582"), ("email", "x.90@mail2")}
    assert set(base) <= set(every)
    clean = "in 2024 we sold 300 of 12.5 at v1.2.3 on 2023-01-02 for $500 to @anna1"
    assert pii.find(clean, w) == ([], [])


def test_the_field_runs_without_any_pattern():
    """Text without a pattern match is treated as it is beside an unrelated one."""
    w = pii.trained()
    text = "write x.90@mail2 or to x.90@mail2 and x.90@mail2 then x.90@mail2"
    base, every = pii.find(text, w)
    assert base == [] and every == [("email", m.start(), m.end()) for m in re.finditer("x.90@mail2", text)]
    for more in (text, "call (487) 555-7209 or 14875557209 and (487) 555-7209"):
        base, every = pii.find("see 1.2.3.4 " + more, w)
        assert set(every) - set(base) == {(k, s + 12, e + 12) for k, s, e in pii.find(more, w)[1]}


def test_evidence_reaches_every_repeat():
    import numpy as np

    w = pii.trained()
    text = "call +1 (487) 555-7209 " + "or 14875557209 " * 40
    g = pii.graph(text, pii.base_spans(text))
    assert np.allclose(pii.beliefs(g, w), pii.beliefs(g, w, 3000), atol=1e-4)
    # on a chain of strong potentials, evidence at one end settles the other
    n, k = 60, len(pii.LABELS)
    features = np.zeros((n, pii.N_FEATURES))
    features[0, 0] = 1
    strong = pii.Weights(np.vstack([np.eye(k)[1] * 9, np.zeros((pii.N_FEATURES - 1, k))]), np.zeros((k, k)), np.eye(k) * 9)
    chain = pii.Graph([(0, 1)] * n, features, np.zeros((0, 2), int), np.array([(i, i + 1) for i in range(n - 1)]), np.zeros(n, int))
    assert pii.beliefs(chain, strong)[-1, 1] > 0.9


def test_message_passing_is_exact_on_trees():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    k = len(pii.LABELS)
    g = pii.Graph([(0, 1)] * 4, rng.normal(size=(4, pii.N_FEATURES)), np.array([[0, 1], [2, 3]]), np.array([[1, 2]]), np.zeros(4, int))
    sym = rng.normal(size=(k, k))
    w = pii.Weights(rng.normal(size=(pii.N_FEATURES, k)), rng.normal(size=(k, k)), sym + sym.T)
    unary = g.features @ w.node
    want = np.zeros((4, k))
    for y in itertools.product(range(k), repeat=4):
        p = np.exp(sum(unary[i, y[i]] for i in range(4)) + w.chain[y[0], y[1]] + w.chain[y[2], y[3]] + w.skip[y[1], y[2]])
        for i in range(4):
            want[i, y[i]] += p
    assert np.allclose(pii.beliefs(g, w, 60), want / want.sum(axis=1, keepdims=True), atol=1e-6)


def test_redacted():
    assert pii.redacted("a b c", [("email", 2, 3)]) == "a [email] c"
    assert pii.redacted("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a[card]f"
