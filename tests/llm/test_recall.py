"""Random keys among many ordinary long tokens."""

from __future__ import annotations

import random
import string

from helpers import documents

from quire.llm import secrets

WORDS = ("user account service manager file system network value index update remove local share package config "
         "module import release version number session request response handler default create table column "
         "harbour morning island water little nothing people government question").split()


def ordinary(rng):
    parts = [rng.choice(WORDS) for _ in range(rng.randint(4, 9))]
    kind = rng.randrange(5)
    if kind == 0:
        parts = [p.title() for p in parts]
    if kind == 1:
        parts.insert(rng.randrange(len(parts)), str(rng.randrange(10_000)))
    if kind == 2:
        parts = [p.upper() for p in parts]
    return rng.choice(("",) if kind == 0 else ("_", "-", "/")).join(parts)[:64].strip("_-/")


def mixture(size, count=20_000, keys=20):
    rng = random.Random(size)
    made = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(size)) for _ in range(keys)]
    tokens = [t for t in (ordinary(rng) for _ in range(count)) if len(t) >= 20]
    return made, made + tokens


def found(spark, tokens):
    rows = [(k, t, "a") for k, t in enumerate(tokens)]
    df = documents(spark, rows).repartition(4)
    return {tokens[r.doc_id] for r in secrets.secret_report(df).filter("n_random > 0").collect()}


def test_rare_random_keys_are_found(spark):
    for size, least in ((20, 10), (28, 16), (40, 19), (64, 20)):
        keys, tokens = mixture(size)
        got = found(spark, tokens)
        print(size, "keys", len(got & set(keys)), "of", len(keys), "others", len(got - set(keys)), "of", len(tokens) - len(keys))
        assert len(got & set(keys)) >= least and len(got - set(keys)) <= 2
