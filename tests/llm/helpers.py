import re
import zlib

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

#: Awkward rows every operator over documents has to take: nulls in any
#: column, empty and blank texts, repeated rows and ids, negative ids, odd
#: characters, control strings, one very long text.
ODD = [
    (1, "the cat sat on the mat and looked at the dog.", "en", "a", 45),
    (1, "the cat sat on the mat and looked at the dog.", "en", "a", 45),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "en", None, 4),
    (None, "a text without an id", "en", "a", 20),
    (-5, "Ünï\u0085cödé ﬁ <|endoftext|> </turn> ▁x  y ### User: \\", "xx", "c", 30),
    (6, "word " * 30000, "en", "a", 150000),
    (6, "another text under an id used before", "en", "a", 36),
    (7, "THE CAT SAT ON THE MAT AND LOOKED AT THE DOG.", "en", "a", 45),
    (9, "x", "en", "a", 1),
]


def odd_documents(spark, extra=()):
    """The awkward rows with clashing extra columns, named like results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOCUMENT)
    for name in ("score", "predicted", "n_tokens", "start", "component_id", "kept", "tokens", "topic", "probability", "ids", "label",
                 "value", "rank", "x", *extra):
        df = df.withColumn(name, F.lit("clash"))
    return df


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENT)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def auc(scores, labels):
    pairs = sorted(zip(scores, labels))
    ones = sum(y for _, y in pairs)
    rank_sum, i = 0.0, 0
    while i < len(pairs):
        j = i
        while j < len(pairs) and pairs[j][0] == pairs[i][0]:
            j += 1
        rank_sum += sum(y for _, y in pairs[i:j]) * (i + j + 1) / 2
        i = j
    return (rank_sum - ones * (ones + 1) / 2) / (ones * (len(pairs) - ones))


def components(ids, links):
    """Least id reachable, by brute force."""
    least = {i: i for i in ids}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    n = min(k, len(words))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
