from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import (
    basename,
    contained_path,
    decode_heading,
    default_secret_rules,
    display_path,
    escape_markdown,
    estimate_tokens,
    fence_length,
    finding_counts,
    first_secret_rule,
    is_binary,
    is_sensitive_name,
    language_of,
    line_count,
    number_lines,
    scope_path,
    split_lines,
    strip_line_numbers,
    visible_text,
    with_final_newline,
)
from quire.functions.sensitive import SecretRule, has_secret


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_binary_boundaries(spark):
    def controls(n, k):
        return b"\x01" * k + b"a" * (n - k)

    cases = [
        (b"", False), (b"plain\n\r\t text", False), (b"nul\0", True),
        (b"\xc3\x28", True), (b"\xc0\x80", True), (b"\xed\xa0\x80", True),
        (b"\xf4\x90\x80\x80", True), (b"\xe2\x82", True), ("é€𐍈".encode(), False),
        (controls(33, 1), True), (controls(34, 1), False), (controls(34, 2), True),
        (controls(100, 2), False), (controls(100, 3), True), (controls(101, 3), False),
        (controls(101, 4), True), (b"\x7f" * 50, False), (b"\xff\xfeh\0i\0", True),
    ]
    assert apply(spark, [bytearray(c) for c, _ in cases], is_binary, "binary") == [w for _, w in cases]


def test_lines_and_fences(spark):
    texts = ["", "x", "x\n", "a\nb", "a\n\nb\n", "\n", "\r\n", "a b\x0bc"]
    assert apply(spark, texts, line_count) == [0, 1, 1, 2, 3, 1, 1, 1]
    assert apply(spark, texts, split_lines) == [
        [], ["x"], ["x"], ["a", "b"], ["a", "", "b"], [""], ["\r"], ["a b\x0bc"]
    ]
    assert apply(spark, ["", "`", "``", "```", "a````b", "```\n`````"], fence_length) == [3, 3, 3, 4, 5, 6]
    assert apply(spark, texts, with_final_newline)[:4] == ["", "x\n", "x\n", "a\nb\n"]


def test_line_numbers(spark):
    text = "\n".join(f"l{i}" for i in range(1, 11))
    (shown,) = apply(spark, [text], lambda c: number_lines(c, line_count(c)))
    assert shown.startswith(" 1 | l1\n") and shown.endswith("10 | l10\n")
    back = apply(spark, [shown, "1 | a\nb\n", "  3 |\n"], strip_line_numbers)
    assert back == [text + "\n", None, "\n"]


def test_tokens(spark):
    sizes = [*range(15), 183_421]
    assert apply(spark, sizes, estimate_tokens, "bigint") == [2 * n // 7 for n in sizes]
    assert 2 * 183_421 // 7 == 52_406


def test_paths(spark):
    assert apply(spark, ["a/b.c", "b", "/x/"], basename) == ["b.c", "b", ""]
    assert apply(spark, ["./a", "a", "././a", ".a"], display_path) == ["a", "a", "./a", ".a"]
    assert apply(spark, ["sub/a", "other/b"], lambda c: scope_path(c, "sub/")) == ["a", "other/b"]


def test_headings(spark):
    raw = ["weird & <name>.txt", "a`b*[c]\\d", "tab\tnl\ncr\r", "\x01\x7f", "café", "\\n", "&amp;", "\\x41"]
    shown = [
        "weird &amp; &lt;name>.txt", "a\\`b\\*\\[c\\]\\\\d", "tab\\tnl\\ncr\\r", "\\x01\\x7F", "café",
        "\\\\n", "&amp;amp;", "\\\\x41",
    ]
    assert apply(spark, raw, escape_markdown) == shown
    assert apply(spark, shown, decode_heading) == raw
    assert apply(spark, ["\\q", "end\\", "\\xZZ"], decode_heading) == ["\\q", "end\\", "\\xZZ"]
    assert apply(spark, ["a*\n", "b\x02"], visible_text) == ["a*\\n", "b\\x02"]


def test_containment(spark):
    paths = ["a/b", "/abs/x", "../x", "a/../b", "a/../../b", "./x//y", "..", "a/..", "x..y/..z"]
    assert apply(spark, paths, contained_path) == [
        "a/b", "abs/x", None, "b", None, "x/y", None, None, "x..y/..z"
    ]


def test_sensitive_names(spark):
    hits = ["credentials.txt", "credential.txt", ".env", ".env.local", "SECRET.txt", "secrets.json",
            "id_dsa", "id_rsa", "ID_ed25519", "x.pem", "x.KEY", "secret"]
    misses = [".envrc", "credentials-prod.txt", "credentials-guide.md", "secretary_notes.md",
              "id_rsa_backup", "id_rsa.pub", "key", "pem", "a.env", "x.key.txt", "a\n.envx"]
    assert all(apply(spark, hits, is_sensitive_name))
    assert not any(apply(spark, misses, is_sensitive_name))


BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
SECRETS = [
    ("AKIA" + "A" * 15, None), ("AKIA" + "A" * 16, "aws_akia"), ("AKIA" + "A" * 17, None),
    ("xASIA" + "0" * 16 + "y", "aws_asia"), ("XASIA" + "0" * 16, None),
    ("ghp_" + "a" * 29, None), ("ghp_" + "a" * 30, "github_ghp"), ("ghr_" + "a" * 255, "github_ghr"),
    ("gho_" + "a" * 256, None), ("-ghs_" + "a" * 30, None), ("ghx_" + "a" * 30, None),
    ("k=sk-" + "a" * 39, None), ("k=sk-" + "a" * 40 + ".", "sk_token"),
    (BEGIN, None), (f"{END}\n{BEGIN}", None), (f"{BEGIN}\nx\n{END}", "rsa_private_key"),
    (f"{BEGIN}\nx\n-----END PRIVATE KEY-----", None),
]


def test_secret_rules(spark):
    rules = default_secret_rules()
    texts = [text for text, _ in SECRETS]
    assert apply(spark, texts, lambda c: first_secret_rule(c, rules)) == [w for _, w in SECRETS]
    assert apply(spark, texts, lambda c: has_secret(c, rules)) == [bool(w) for _, w in SECRETS]
    found = apply(spark, ["AKIA" + "A" * 16 + " AKIA" + "B" * 16], lambda c: finding_counts(c, rules))
    assert [(f.rule, f.n_hits) for f in found[0]] == [("aws_akia", 2)]


def test_context_rule(spark):
    rule = SecretRule("t", "tok_[a-z]{8,12}", hint="tok_", alphabet="a-z", needs_context=True)
    token = "tok_abcdefgh"
    cases = [
        (f"key = {token}", True), (f"x: {token}", True), (f"Bearer {token}", True),
        (f"see {token}", False), (f"=\n{token}", False), ("=" + " " * 31 + token, True),
        ("=" + " " * 32 + token, False), ("=" + "é" * 15 + " " + token, True),
        ("=" + "é" * 16 + token, False),
    ]
    assert apply(spark, [c for c, _ in cases], rule.found_in) == [w for _, w in cases]
    assert apply(spark, [c for c, _ in cases], rule.hits_in) == [int(w) for _, w in cases]


LANGUAGES = [
    ("a/Dockerfile", "", "dockerfile"), ("GNUMAKEFILE", "", "makefile"), ("x.PY", "", "python"),
    ("x.tar.rs", "", "rust"), ("x.unknown", "#!/bin/sh\n", None), ("x.", "#!/bin/sh\n", None),
    (".bashrc", "#!/bin/sh\n", "bash"), ("run", "#!/usr/bin/env -S -i python3 -x\n", "python"),
    ("run", "#! \t/bin/bash -e", "bash"), ("run", "#!/usr/bin/env", None), ("run", "#!/usr/bin/env -S", None),
    ("run", "#!/usr/bin/python3.11\n", None), ("run", "#!/usr/bin/env node\r\n", "javascript"),
    ("run", "#!/usr/bin/python/\n", None), ("run", "#!env perl", "perl"), ("run", "#!\nbash", None),
    ("run", "#!" + " " * 253 + "sh", None), ("run", "#!" + " " * 251 + "sh", "bash"),
    ("a.b/run", "#!lua", "lua"), ("run", " #!/bin/sh", None),
]


def test_languages(spark):
    df = spark.createDataFrame(
        [(i, p, bytearray(c.encode())) for i, (p, c, _) in enumerate(LANGUAGES)],
        "i int, p string, c binary",
    )
    got = df.orderBy("i").select(language_of(F.col("p"), F.col("c"))).collect()
    assert [r[0] for r in got] == [w for *_, w in LANGUAGES]


