"""Plain-Python counterparts and small hostile inputs."""

import collections
import hashlib
import random
import re

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, hits string, number long, word string, bin string, root string"


def words(text):
    return PLAIN.findall(text or "")


def normal(text):
    return NORMAL.findall((text or "").translate(ASCII_LOWER))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeated_windows(sequences, length):
    count = collections.Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    return [[i for i in range(len(s) - length + 1) if count[tuple(s[i : i + length])] > 1] for s in sequences]


def hostile_texts(seed=5, n=40):
    """Shared passages, copies, near copies, short, empty, null, blank and very long texts."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in "bcdfgklmnrst" for b in ("a", "é", "io", "u", "er")]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = prose(60), prose(120)
    texts = [None, "", "   \n\t ", "one", "two words", "Ünïcode ß 漢字 🙂 ok", passage, passage, base, base]
    for i in range(n):
        kind = i % 5
        if kind == 0:
            texts.append(prose(rng.randint(1, 80)))
        elif kind == 1:
            texts.append(prose(30) + "\n" + passage + " " + prose(rng.randint(0, 30)))
        elif kind == 2:
            changed = base.split(" ")
            changed[rng.randrange(120)] = "changed"
            texts.append(" ".join(changed))
        elif kind == 3:
            texts.append((prose(9) + "\n") * rng.randint(1, 6))
        else:
            texts.append(base if i % 2 else "la " * rng.randint(1, 90))
    texts.append(prose(6000) + " " + passage)
    return texts


def documents(spark, texts, **options):
    """A table with clashing extra columns; ids repeat where texts do at the end."""
    rows = [(i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t), 7, "x", 1, "w", "b", "r") for i, t in enumerate(texts)]
    rows += [rows[0], rows[-1], rows[-1]] if options.get("repeat", True) and rows else []
    return spark.createDataFrame(rows, DOCS)
