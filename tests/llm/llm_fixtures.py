"""Documents for the tests of the operators here."""

import zlib

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, token string, digest string, bucket int, shard string, a int, b int, part string, fp string"


def words(seed: int, n: int, kinds: int = 5000) -> list[str]:
    """Invented words: the same for the same seed."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(f"w{(x >> 33) % kinds:x}")
    return out


def passage(seed: int, n: int, line: int = 8) -> str:
    w = words(seed, n)
    return "\n".join(" ".join(w[i : i + line]) for i in range(0, n, line))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies and shared passages."""
    long = passage(1, 6000)
    base = passage(2, 120)
    near = base.split(" ")
    near[30] = "changed"
    shared = passage(3, 60)
    texts = [
        (0, base), (1, " ".join(near)), (2, base), (3, base.upper()), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one"),
        (9, "one two three"), (10, "One two THREE"), (11, long), (12, long + " more"), (13, passage(4, 50) + "\n" + shared),
        (14, shared + "\n" + passage(5, 70)), (15, passage(6, 40) + "\n" + shared + "\n" + passage(7, 40)), (15, passage(8, 30)),
        (16, passage(9, 30)), (16, passage(9, 30)), (None, passage(10, 30)), (None, base), (-5, passage(11, 14) + " é, ß! 日本 12 3.5\n\n x  y"),
        (2**40, "a a a a a a a a a a a a a a a a a a a a"), (2**40 + 1, "a a a a a a a a a a a a a a a"), (17, "!!! ... 123"),
    ]
    rows = []
    for k, (doc_id, text) in enumerate(texts):
        rows.append((doc_id, text, None if k % 3 else "en", None if k % 4 else "s", None if k % 5 else k, "t", None, k, "x", 1, None, "p", "f"))
    return rows


def crc(data: bytes) -> int:
    return zlib.crc32(data)
