import hashlib
import random
import re

import pytest

from terrace.llm import secrets

RULES = [
    (re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), "assign", lambda m: len(m[2]) >= 8),
    (re.compile(r"AKIA[A-Z0-9]+"), "access", lambda m: len(m[0]) >= 16),
    (re.compile(r"[0-9a-f]+"), "hex", lambda m: len(m[0]) >= 32),
]


def brute(text):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (p, name, good) in enumerate(RULES) for m in p.finditer(text or "") if good(m)]
    return [s for _, _, s in sorted(found)]


def texts():
    rng = random.Random(9)
    hexa = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    out = ["", None, f'token = "{hexa}"', "token: secret: abcdefgh12", "PassWord=hunter2longer token=password=abcdefghijk", "AKIA" + "A1B2C3D4E5F6G7H8", "AKIAshort", hexa[:31], hexa[:32], "ſecret=abcdefgh", "toKen=abcdefghij", "é" * 50 + f" api_key='{hexa}' apikey:x.y-z/+=_9", "x" * 100000 + " secret=" + "k" * 50]
    pool = ["token", "secret", "=", ":", " ", '"', "'", "api_key", "AKIA", "ABCDEF0123456789", "deadbeef" * 4, "abc", "é", "\n", "passwd", "password"]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 25))) for _ in range(300)]


def test_base_spans_against_plain_patterns(spark):
    rows = [(k, t, "clash") for k, t in enumerate(texts())] + [(None, "token=abcdefgh", "x"), (0, "token=abcdefgh", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    want = sorted((-1 if i is None else i, hashlib.sha256(",".join(brute(t)).encode()).hexdigest(), sum(s.startswith("assign") for s in brute(t))) for i, t, _ in rows)
    out = secrets.scan(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.base_sha256, r.n_assign) for r in out) == want
    for r in out:
        assert r.n_assign + r.n_access + r.n_hex + r.n_random == len([s for s in r.spans.split(",") if s])
    assert secrets.scan(df.limit(0)).count() == 0


def _random_token(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_battery_tells_random_from_structured():
    rng = random.Random(4)
    alphabets = [secrets.ENCODINGS[k] for k in ("base62", "base64", "base36", "base32")]
    good = [secrets.battery(_random_token(rng, rng.choice(alphabets), rng.randint(28, 64))) for _ in range(400)]
    words = ["international", "configuration", "thandheaouing", "administrator", "documentation", "abcabcabcabcabc"]
    bad = [secrets.battery(rng.choice(words) + rng.choice(words) + rng.choice(words)) for _ in range(200)]
    assert sum(p > 0.01 for p in good) > 370
    assert sum(p > 0.01 for p in bad) < 10
    assert secrets.battery("a" * 40) < 1e-6 and secrets.battery("short") == 0.0 and secrets.battery("0123456789" * 4) < 0.01


def test_reported_tokens_are_random(spark):
    """Precision of each encoding: of random keys most are reported, of structured tokens few."""
    import base64
    import uuid

    rng = random.Random(12)
    syllables = ["con", "fi", "gu", "ra", "tion", "ser", "vice", "man", "age", "re", "port", "in", "ter", "na", "ment", "doc", "u", "val", "id"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    camel = lambda: word() + "".join(word().title() for _ in range(4))
    make = {
        "random base62": lambda: _random_token(rng, secrets.ENCODINGS["base62"], 40),
        "random base64": lambda: _random_token(rng, secrets.ENCODINGS["base64"], 44),
        "random base64url": lambda: _random_token(rng, secrets.ENCODINGS["base64url"], 43),
        "random HEX": lambda: _random_token(rng, secrets.ENCODINGS["HEX"], 40),
        "camel": camel,
        "snake": lambda: "_".join(word() for _ in range(5)),
        "path": lambda: "/".join(word() for _ in range(5)),
        "prose in base64": lambda: base64.b64encode(prose(6).encode()).decode().rstrip("="),
        "prose in HEX": lambda: prose(4).encode().hex().upper(),
        "digits": lambda: "978" + _random_token(rng, "0123456789", 23),
        "uuid": lambda: str(uuid.UUID(int=rng.getrandbits(128))),
    }
    rows, kind = [], {}
    for k in range(2200):
        name = list(make)[k % len(make)] if k % 2 else list(make)[4 + k % 7]
        token = make[name]()
        rows.append((k, f"{prose(40)} {token} {prose(10)}"))
        kind[k] = name
    out = {r.doc_id: r.n_random for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    share = {n: [out[k] > 0 for k in out if kind[k] == n] for n in make}
    wrong = sum(sum(x) for n, x in share.items() if not n.startswith("random"))
    right = sum(sum(x) for n, x in share.items() if n.startswith("random"))
    assert wrong <= 0.1 * (wrong + right), share
    for n, x in share.items():
        if n.startswith("random"):
            assert sum(x) >= 0.8 * len(x), (n, sum(x), len(x))


def test_discoveries_are_controlled_within_classes():
    base62 = secrets._KINDS.index("base62")
    null = [(1, base62, at, 10) for at in range(20, 120)] + [(1, base62, 3, 1)]
    found = [(1, base62, 1, 5), (1, base62, 2, 5), (1, base62, 60, 20), (2, base62, 1, 5)]
    assert secrets.discoveries(found, null, 0.05) == {(1, base62): 2}
    assert secrets.discoveries(found, null, 1e-9) == {} and secrets.discoveries([], null, 0.05) == {}


def test_structured_tokens_come_from_the_text():
    text = "The quick brown fox jumps over lazy dogs and runs"
    tokens = secrets.structured(text)
    assert tokens == secrets.structured(text) and secrets.structured("one two") == [] and secrets.structured("") == []
    assert {secrets.infer_encoding(t) for t in tokens} >= {"base62", "base64url", "base64", "hex", "HEX"} and max(map(len, tokens)) < 200


def test_values_after_names_are_tokens():
    rng = random.Random(3)
    key = _random_token(rng, secrets.ENCODINGS["base64"], 38) + "+/"
    for text in (f"AWS_ACCESS_KEY_OF_OURS={key}", f"KEY={key}", f"K={key}== x", f"deploy_key_{key}", key):
        ends = text.index(key) + len(key) + 2 * ("== x" in text)
        found = [(a, b) for a, b, p in secrets.opaque_tokens(text, []) if p > 0.01]
        assert found == [(text.index(key), ends)], text


def test_random_tokens_are_found_among_words_and_redacted(spark):
    rng = random.Random(8)
    words = ["internationalconfigurations", "administratordocumentation", "thandheaouingthandheaouing"]
    pool = "what follows comes from a letter that nobody has read since winter began there".split()
    keys = [_random_token(rng, secrets.ENCODINGS["base62"], 40) for _ in range(40)]
    rows = [(k, f"see {key} here token=abcdefgh1 {' '.join(rng.sample(pool, 9))}", None) for k, key in enumerate(keys)] + [(100 + k, f"plain {rng.choice(words)} text {' '.join(rng.sample(pool, 9))}", None) for k in range(200)] + [(500, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    out = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert sum(out[k].n_random for k in range(40)) >= 36
    assert sum(out[100 + k].n_random for k in range(200)) <= 4
    clean = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert clean[500].text is None and clean[500].other == "x" and clean[100].text == rows[40][1]
    assert all("abcdefgh1" not in clean[k].text and "[SECRET]" in clean[k].text for k in range(40))


@pytest.mark.parametrize("n,want", [(20, 0), (27, 0), (28, 1), (40, 2), (64, 3), (500, 4)])
def test_length_classes(n, want):
    assert secrets.length_class(n) == want
