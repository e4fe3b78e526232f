import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, h long, id int, line string, ids string, kept boolean, path string, part int, m int, bucket int, removed string, leaked int"


def words(rnd, n):
    return [rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + rnd.choice("uvwxyz") * rnd.randrange(1, 4) + str(rnd.randrange(40)) * (rnd.random() < 0.2) for _ in range(n)]


def rows(texts):
    """Extra columns have names that the operators use inside."""
    return [(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, "l", "i", True, "p", 4, 5, 6, "r", 7) for i, t in texts]


@pytest.fixture(scope="session")
def texts():
    """Null and empty texts, null and repeated ids, equal rows, near copies, repeated lines and passages, a very long text."""
    rnd = random.Random(3)
    out = []
    passage = " ".join(words(rnd, 60)).capitalize() + ". " + " ".join(words(rnd, 30)).capitalize() + "."
    for i in range(40):
        lines = [" ".join(words(rnd, rnd.randrange(4, 30))).capitalize() + "." for _ in range(rnd.randrange(1, 9))]
        if i % 9 == 4:
            lines.insert(len(lines) // 2, passage)
        if i % 5 == 0:
            lines.append("the common line of many pages here.")
        out.append((i, "\n".join(lines)))
    base = out[7][1].split(" ")
    for k in range(5):
        near = list(base)
        near[(k * 3) % len(near)] = f"changed{k}"
        out.append((100 + k, " ".join(near)))
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one two three"), (205, "one two three"), (None, "text of no id\nsecond line of it"), (3, out[3][1]), (3, out[3][1]), (5, "another text with the same id.")]
    out.append((300, "\n".join(" ".join(words(rnd, 40)) for _ in range(400))))
    out.append((301, "a" * 5000 + " " + "1" * 3000 + "@" + "b" * 3000))
    out.append((302, "é́ naïve　space  no-break ﻿bom <|endoftext|> 漢字\x1cx 'tis it's"))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
