import hashlib
import re
from collections import Counter

from codeassay.catalog.js_rules import js_rules
from codeassay.catalog.secrets import GATE_ASSIGN, GATE_ASSIGN_WORD, GATE_RUN, secret_rules
from codeassay.functions.regex import spark_regex

TOKEN = hashlib.md5(b"1").hexdigest() * 4


def sample_text(rule):
    head, n, upper, tail = rule.sample
    return head + (TOKEN.upper() if upper else TOKEN)[:n] + tail


def test_catalog_sizes_and_ratings():
    secrets, js = secret_rules(), js_rules()
    assert len(secrets) == 200 and len({r.rule_id for r in secrets}) == 200
    assert Counter(r.severity for r in secrets) == {"critical": 175, "warning": 24, "info": 1}
    assert Counter(r.confidence for r in secrets) == {"high": 193, "medium": 7}
    assert [r.rule_id for r in js] == [f"SG-{n:03d}" for n in range(30, 70)]
    assert Counter(r.severity for r in js) == {"critical": 13, "warning": 22, "info": 5}
    assert sum(r.anti_pattern is not None for r in js) == 20


def test_every_secret_sample_matches_pattern_and_gate():
    gates = {
        "assign": lambda t: re.search(GATE_ASSIGN, t) and re.search(GATE_ASSIGN_WORD, t),
        "run": lambda t: re.search(GATE_RUN, t), "uri": lambda t: "://" in t, "pem": lambda t: "-----BEGIN" in t,
        "header": lambda t: "uthorization" in t, "service": lambda t: "service_account" in t,
        "account": lambda t: "AccountKey=" in t, "sig": lambda t: "sig=" in t, "define": lambda t: "define(" in t,
    }
    for r in secret_rules():
        t = sample_text(r)
        assert re.search(r.pattern, t), r.rule_id
        assert gates[r.gate](t), r.rule_id


def test_ascii_word_boundary():
    assert spark_regex(r"\beval\b") == r"(?<!\w)eval(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    assert spark_regex(r"[\b]x") == r"[\b]x"
