"""Formats with fewer values than entities: surrogates grow until all differ."""

import re
import string

from docloom.llm import pii


def test_surrogates_grow_where_a_format_has_too_few_values(spark):
    letters = string.ascii_lowercase
    names = [f"Mr X{a}{b}{c} Smith" for a in letters[:13] for b in letters[:13] for c in letters[:13]]  # 2,197: over 12 + 144 + 1,728
    mails = [f"{'Q' if a == 'q' else a}@One.example.com" for a in letters]
    phones = [f"+1 {k // 100:02d} {k % 100:02d}" for k in range(6_000)]  # over half of the format's values
    texts = ["; ".join(names), "; ".join(mails), "; ".join(phones)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {r["doc_id"]: r["text"].split("; ") for r in pii.pseudonymize(docs, "k", count_col="n").collect()}
    for k, real in enumerate((names, mails, phones)):
        assert len(made[k]) == len(set(made[k])) == len(real) and not {m.lower() for m in made[k]} & {m.lower() for m in real}
    family = {m.split()[-1] for m in made[0]}
    assert len(family) == 1 and all(m.startswith("Mr ") and set(m.split()[1:-1]) <= set(pii.GIVEN["m"]) for m in made[0])
    assert all(re.fullmatch(r"[A-Za-z]+@[A-Z][a-z]{2}\.[a-z]{7}\.com", m) for m in made[1]) and len({m.split("@")[1] for m in made[1]}) == 1
    assert made[1][letters.index("q")][0].isupper()
    assert all(re.fullmatch(r"\+1 \d\d \d{2,}", m) for m in made[2])
