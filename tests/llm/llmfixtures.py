import re

SF = "/root/testdata/sf0.001"

#: Null ids, null, empty and blank texts, repeated rows, a text without letters and a character beyond the BMP.
EDGES = [(None, "null id here"), (1, None), (2, ""), (3, "   \n\t "), (4, "!!! ..."), (5, "Same words again"), (5, "Same words again"), (6, "naïve 日本語 𝔘 it's we'll 12,5"), (7, "a")]


def tokens(t):
    """Words, in lower case where Latin-1."""
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if ord(c) < 256 else c for c in t))
