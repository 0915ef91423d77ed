"""Search vectors: a lexer of titles and URLs, lexemes with weighted positions, and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token, tried in this order at each place of the lower-cased text. Tags, entities and protocols are passed over.
TAG = r"<[/!?]?[a-z][^<>]*>"
ENTITY = r"&(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+);"
PROTOCOL = r"[a-z][a-z0-9+.-]*://"
HOST = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z][a-z]+(?::[0-9]+)?"
EMAIL = r"[a-z0-9][a-z0-9._-]*@" + HOST
PATH = r"/[!#-;=?-Z\[\]_a-z~]*"
COMPOUND = r"\p{L}[\p{L}\p{N}]*(?:-\p{L}[\p{L}\p{N}]*)+"
WORD = r"[0-9]*\p{L}[\p{L}\p{N}]*"
NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)*"
TOKEN = f"(?:{TAG}|{ENTITY}|{PROTOCOL}|{EMAIL}|{HOST}(?:{PATH})?|{COMPOUND}|{WORD}|{NUMBER})"
PASSED = f"^(?:{TAG}|{ENTITY}|{PROTOCOL})$"
URL = f"^({HOST})({PATH})$"
#: Positions are kept up to this one.
LAST_POSITION = 16_383


def lexemes(text: Column) -> Column:
    """Array of lexemes in order: a URL is followed by its host and its path, a hyphen compound by its parts."""
    found = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda x: ~x.rlike(PASSED))
    parts = lambda x: F.when(x.rlike(URL), F.array(x, F.regexp_extract(x, URL, 1), F.regexp_extract(x, URL, 2))).when(x.rlike(f"^{COMPOUND}$"), F.concat(F.array(x), F.split(x, "-"))).otherwise(F.array(x))
    return F.flatten(F.transform(found, parts))


def search_tokens(title: Column, url: Column) -> Column:
    """Array of (token, weight, pos): a title's lexemes weigh A, a URL's B; positions run on from the title's."""
    place = lambda pos: F.least(pos, F.lit(LAST_POSITION)).cast("int")
    tag = lambda c, weight, offset: F.transform(c, lambda x, i: F.struct(x.alias("token"), F.lit(weight).alias("weight"), place(i + 1 + offset).alias("pos")))
    first, second = lexemes(title), lexemes(url)
    return F.concat(tag(first, "A", F.lit(0)), tag(second, "B", F.least(F.size(first), F.lit(LAST_POSITION))))


def vector_text(tokens: Column) -> Column:
    """The vector as text: lexemes in order, quoted, each with its positions and weights, as in ``'a':1A,3B 'b':2A``.

    Every token has its place in it: those past ``LAST_POSITION`` share that position and are each listed. One sort, so the work grows with the tokens, not with their square.
    """
    opened = lambda x: F.concat(F.lit("'"), F.replace(x["token"], F.lit("'"), F.lit("''")), F.lit("':"))
    head = lambda s, x, i: F.when(i == 0, opened(x)).when(F.get(s, i - 1)["token"] != x["token"], F.concat(F.lit(" "), opened(x))).otherwise(",")
    text = lambda s: F.array_join(F.transform(s, lambda x, i: F.concat(head(s, x, i), x["pos"].cast("string"), x["weight"])), "")
    in_order = F.array_sort(F.transform(tokens, lambda x: F.struct(x["token"].alias("token"), x["pos"].alias("pos"), x["weight"].alias("weight"))))
    # The sorted array is bound to a name; written twice, it would be sorted again for each token.
    return F.element_at(F.transform(F.array(in_order), text), 1)
