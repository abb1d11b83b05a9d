import random
import re

from tessera.llm import pii_surrogates
from tessera.llm.common import Scratch


def test_spent_shapes_get_longer_surrogates(spark):
    rng = random.Random(1)
    short = rng.sample([f"{a}@{b}.co" for a in pii_surrogates.LATIN for b in pii_surrogates.LATIN], 600)  # of 676
    fixed = ["%@-.com", "_@--.org", "%" * 64 + "@-.com"]
    entities = [("email", e) for e in short + fixed] + [("male", "smith"), ("ip", "1.2.3.4")]
    got = pii_surrogates.assign(spark.createDataFrame(entities, "kind string, entity string"), "key", Scratch(spark)).collect()
    made = {(r.kind, r.entity): r.made for r in got}
    assert set(made) == set(entities) and len({(k, m) for (k, _), m in made.items()}) == len(entities)
    assert not {(k, m) for (k, _), m in made.items()} & set(entities)
    assert all(re.fullmatch(pii_surrogates.KINDS["email"], made["email", e]) for e in short + fixed)
    assert all(made["email", e].rsplit(".")[-1] == e.rsplit(".")[-1] for e in short + fixed)


def test_addresses_without_letters_do_not_end_the_query(spark):
    docs = spark.createDataFrame([(1, "mail %@-.com and _@--.ORG now"), (2, "again %@-.com")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii_surrogates.replace(docs, "key", Scratch(spark)).collect()}
    one, two = re.fullmatch(r"mail (\S+@-\.com) and (\S+@--\.ORG) now", got[1]), re.fullmatch(r"again (\S+)", got[2])
    assert one and two and one[1] == two[1] != "%@-.com" and one[2].lower() != "_@--.org"
