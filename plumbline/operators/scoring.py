"""Scoring answers, comparing baselines, cutting tables and texts to size, findings on lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.textual import bound

#: Types of scoring, points of a calibration item, row caps that a table is halved through, the size below which a delta is noise.
KINDS = ("exact_match", "numeric_tolerance", "calibration")
POINTS = {"correct": 1.0, "wrong": -1.0, "idk_answerable": 0.2, "idk_unanswerable": 1.0}
ROW_CAPS, SMALL = (40, 20, 10, 5, 4), 30
#: A whole number (sign, thousands, fraction, exponent), and what a terminal adds to a text.
NUMBER = r"(?<![\w.])[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.]*\d)"
TERMINAL = r"\x1b(?:\[[0-9;?]*[a-zA-Z]|[()][0-9A-B]|[=>])"
#: Phrases that say an answer is not known.
ABSTAINS = [
    r"\bi\s*don'?t\s*know\b",
    r"\bi\s*do\s*not\s*know\b",
    r"\bno\s*idea\b",
    r"\bnot\s*(?:enough|sufficient)\s*information\b",
    r"\bcannot\s*(?:be\s*)?determin",
    r"\bcan'?t\s*(?:be\s*)?determin",
    r"\bunable\s*to\s*(?:determine|answer|know)\b",
    r"\bunanswerable\b",
    r"\bnot\s*answerable\b",
    r"\bimpossible\s*to\s*(?:know|determine|answer)\b",
    r"\bi'?m\s*not\s*sure\b",
    r"\bi\s*am\s*not\s*sure\b",
    r"\bunknown\b",
    r"\bunknowable\b",
    r"\bn\s*/\s*a\b",
    r"\bno\s*way\s*(?:to|of)\s*know",
    r"\bcannot\s*say\b",
]
#: Shortest secret, least bits a character, words that mark a placeholder, names that mean a secret, prefixes of keys that are public.
SECRET_LENGTH, SECRET_BITS = 16, 3.5
PLACEHOLDERS = ("changeme", "change_me", "replace", "placeholder", "your", "example", "sample", "dummy", "insert", "redacted", "todo", "notreal", "xxxx", "aaaa", "<", ">", "${", "{{", "...")
SECRET_NAME = r"(?i)(_KEY|_TOKEN|_SECRET|_CREDENTIAL|_PASSWORD|APIKEY|PASSWORD)$"
SECRET_NAMES = ("authorization", "token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "x-api-key", "access_token")
PUBLIC = ("sk_test_", "rk_test_", "pk_test_", "pk_live_", "whsec_test_")
#: Fixed value: a line that sets a variable.
ENV_LINE = r"^([A-Z][A-Z0-9_]*)\s*=\s*(\S{8,})$"


def plain_answer(text: Column) -> Column:
    """Without what a terminal adds, lower-cased, white space collapsed, without full stops, exclamation and question marks at the end."""
    collapsed = F.trim(F.regexp_replace(F.regexp_replace(text, TERMINAL, ""), r"(?U)\s+", " "))
    return F.regexp_replace(F.lower(collapsed), r"[.!?]+$", "")


def holds_token(text: Column, answer: Column) -> Column:
    """Whether an answer stands in a text as a token of its own: not inside a word, nor as part of a longer number."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(answer, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return (answer != "") & F.regexp_like(text, F.concat(F.lit(r"(?U)(?<!\w)(?<![\d.])"), quoted, F.lit(r"(?!\w)(?![.,]?\d)")))


def holds_number(text: Column, value: Column, tolerance: float) -> Column:
    """Whether any whole number in a text lies within the tolerance; thousands and exponents are read, parts of other numbers aren't."""
    found = F.regexp_extract_all(F.regexp_replace(text, TERMINAL, ""), F.lit(f"(?U)({NUMBER})"), 1)
    return F.exists(found, lambda x: F.coalesce(F.abs(F.replace(x, F.lit(","), F.lit("")).try_cast("double") - value) <= tolerance, F.lit(False)))


def abstains(text: Column) -> Column:
    """Of a plain answer: whether it says that the answer is not known."""
    return text.rlike("(?iU)" + "|".join(ABSTAINS))


def score_item(kind: Column, text: Column, answer: Column, number: Column, answerable: Column, tolerance: float = 1e-6, distractors: Column | None = None) -> Column:
    """Points by the item's kind (KINDS; any other is an error); null where nothing was answered (an error, not a zero).

    An answer that also names one of the item's distractors (known wrong
    answers) only lists what it could be: no match, and for a calibration item
    no more than an abstention.
    """
    said, plain = plain_answer(text), plain_answer(answer)
    hit = F.coalesce((plain != "") & ((said == plain) | holds_token(said, plain)), F.lit(False))
    listed = F.lit(False) if distractors is None else hit & F.coalesce(F.exists(distractors, lambda d: holds_token(said, plain_answer(d))), F.lit(False))
    right = hit & ~listed
    idk = F.when(answerable, POINTS["idk_answerable"]).otherwise(POINTS["idk_unanswerable"])
    calibrated = F.when(answerable & right, POINTS["correct"]).when((answerable & listed) | abstains(said), idk).otherwise(POINTS["wrong"])
    return (
        F.when(text.isNull(), F.lit(None).cast("double"))
        .when(kind == "exact_match", right.cast("double"))
        .when(kind == "numeric_tolerance", holds_number(text, number, tolerance).cast("double"))
        .when(kind == "calibration", calibrated)
        .otherwise(F.raise_error(F.concat(F.lit("unknown scoring type "), F.coalesce(kind, F.lit("null")))).cast("double"))
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row on two runs (id, score; null: not scored): flips, mean and its change, scope and a note on noise.

    A probe that was scored in one run only has flipped. Scope says where
    probes went unscored, since a mean over the rest can't show it.
    """
    met = before.select("id", F.col("score").alias("x")).join(after.select("id", F.col("score").alias("y")), "id")
    sums = met.agg(F.count("*").alias("n"), F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("flips"), F.round(F.avg("x"), 6).alias("mean_before"), F.round(F.avg("y"), 6).alias("mean_after"), F.count_if(F.col("x").isNull()).alias("unscored_before"), F.count("y").alias("scored"))
    unscored_after = F.col("n") - F.col("scored")
    scope = F.when((F.col("unscored_before") > 0) & (unscored_after > 0), "bounded_both_unscored").when(F.col("unscored_before") > 0, "bounded_before_unscored").when(unscored_after > 0, "bounded_after_unscored").otherwise("full")
    delta = F.round(F.col("mean_after") - F.col("mean_before"), 6)
    noise = F.when((F.col("scored") == 0) | delta.isNull() | (F.col("scored") >= SMALL), F.lit(None).cast("string")).when(F.abs(delta) < 2 / F.col("scored"), "within_noise").otherwise("small_sample")
    return sums.select("n", "flips", "mean_before", "mean_after", delta.alias("delta"), scope.alias("scope"), noise.alias("note"))


def set_digest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One digest of a set of (key, value), whatever its order: a sum and an exclusive or of the rows' hashes, and their number.

    No list is gathered, so a set of any size is one aggregate.
    """
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct(key, value)), 256), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(38,0)")).cast("string").alias("total"), F.bit_xor(one).alias("mix"))


def is_table(text: Column) -> Column:
    """At least three lines that aren't blank, whose numbers of tabs, bars or commas are above zero first and at most two different ones."""

    def told(lines: Column) -> Column:
        def by(mark: str) -> Column:
            counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit(""))))
            return bound(counts, lambda c: (F.get(c, F.lit(0)) > 0) & (F.size(F.array_distinct(c)) <= 2))

        return (F.size(lines) >= 3) & (by("\t") | by("|") | by(","))

    return F.coalesce(bound(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), told), F.lit(False))


def kind_of(text: Column) -> Column:
    """json (an object or a list), table or text."""
    return F.when(text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull(), "json").when(is_table(text), "table").otherwise("text")


def fit_rows(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """(key, cap, kept, dropped, digest) with the largest cap on a key's rows whose head and tail stay within the budget.

    The head has half the cap, rounded up. digest: an order-free digest of the
    dropped rows' text. The smallest cap is used where none fits.
    """
    by = Window.partitionBy(key)
    numbered = rows.select(key, text, F.row_number().over(by.orderBy(order)).alias("k"), F.count("*").over(by).alias("n"), F.length(text).alias("size"))
    kept_in = lambda cap: (F.col("n") <= cap) | (F.col("k") <= -(-cap // 2)) | (F.col("k") > F.col("n") - cap // 2)
    sums = numbered.groupBy(key).agg(F.max("n").alias("n"), *[F.coalesce(F.sum(F.when(kept_in(c), F.col("size"))), F.lit(0)).alias(f"s{c}") for c in ROW_CAPS])
    cap = F.coalesce(*[F.when(F.col(f"s{c}") <= budget, c) for c in ROW_CAPS], F.lit(ROW_CAPS[-1]))
    chosen = sums.select(key, cap.alias("cap"))
    cut = numbered.join(chosen, key).where((F.col("n") > F.col("cap")) & (F.col("k") > F.ceil(F.col("cap") / 2)) & (F.col("k") <= F.col("n") - F.floor(F.col("cap") / 2)))
    lost = cut.groupBy(key).agg(F.count("*").alias("dropped"), F.bit_xor(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")).alias("digest"))
    return sums.select(key, "n").join(chosen, key).join(lost, key, "left").select(key, "cap", (F.col("n") - F.coalesce("dropped", F.lit(0))).alias("kept"), F.coalesce("dropped", F.lit(0)).alias("dropped"), "digest")


def sentences(text: Column) -> Column:
    """Parts behind each full stop, exclamation or question mark that white space follows."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def chunks(rows: DataFrame, most: int) -> DataFrame:
    """(key, chunk, offset, size): paragraphs (ending behind their line feeds) filled into chunks of at most `most` characters, in order.

    A paragraph that is longer is a chunk of its own. The chunks of a text,
    joined, are the text; a fold inside each row finds where they begin.
    """
    parts = F.filter(F.regexp_extract_all(F.col("text"), F.lit(r"((?s:.+?)(?:\n+|\z))"), 1), lambda x: x != "")
    sizes = rows.select("key", F.transform(parts, F.length).alias("sizes"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<struct<offset:int,size:int>>").alias("done"))

    def add(state: Column, size: Column) -> Column:
        full = (state["held"] > 0) & (state["held"] + size > most)
        done = F.when(full, F.concat(state["done"], F.array(F.struct((state["at"] - state["held"]).alias("offset"), state["held"].alias("size"))))).otherwise(state["done"])
        return F.struct((state["at"] + size).alias("at"), F.when(full, size).otherwise(state["held"] + size).alias("held"), done.alias("done"))

    folded = sizes.select("key", F.aggregate("sizes", start, add).alias("s"))
    last = F.when(F.col("s.held") > 0, F.array(F.struct((F.col("s.at") - F.col("s.held")).alias("offset"), F.col("s.held").alias("size")))).otherwise(F.array().cast("array<struct<offset:int,size:int>>"))
    each = folded.select("key", F.posexplode(F.concat("s.done", last)).alias("chunk", "c"))
    return each.select("key", "chunk", "c.offset", "c.size")


def bits(value: Column) -> Column:
    """Shannon entropy in bits a character, within the row."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def redacted(secret: Column) -> Column:
    head = F.when(F.length(secret) > 10, F.substring(secret, 1, 6)).otherwise(F.substring(secret, 1, 2))
    return F.concat(head, F.lit("... ("), F.length(secret).cast("string"), F.lit(" chars)"))


def live_secret(value: Column) -> Column:
    """Long enough, no white space, neither public nor a placeholder, letters and digits, and as many bits a character as a credential has."""
    low = F.lower(value)
    named = F.lit(False)
    for p in PLACEHOLDERS:
        named = named | F.contains(low, F.lit(p))
    return (F.length(value) >= SECRET_LENGTH) & ~value.rlike(r"(?U)\s") & ~public_key(value) & ~named & value.rlike(r"\p{L}") & value.rlike(r"\p{Nd}") & (bits(value) >= SECRET_BITS)


def public_key(value: Column) -> Column:
    found = F.lit(False)
    for p in PUBLIC:
        found = found | value.startswith(p)
    return found


def secret_name(name: Column) -> Column:
    return name.rlike(SECRET_NAME) | F.lower(name).isin(list(SECRET_NAMES))


def vendor_hit(value: Column, shapes: dict[str, str]) -> Column:
    """struct(shape, match) of the first published shape that a value holds; null where none, or where the value is a public key."""
    found = [F.when(value.rlike(p), F.struct(F.lit(name).alias("shape"), F.regexp_extract(value, f"({p})", 1).alias("match"))) for name, p in shapes.items()]
    return F.when(~public_key(value), F.coalesce(*found))


def env_findings(rows: DataFrame, shapes: dict[str, str]) -> DataFrame:
    """(key, line, name, level, what, shown) of NAME=value lines: a vendor's shape is high, a secret's name with a live value medium."""
    lines = rows.select("key", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "raw"))
    part = lambda i: F.regexp_extract(F.trim("raw"), ENV_LINE, i)
    named = lines.select("key", (F.col("line") + 1).alias("line"), part(1).alias("name"), F.trim(part(2), F.lit("'\"")).alias("value")).where("name <> ''")
    named = named.withColumn("hit", vendor_hit(F.col("value"), shapes))
    level = F.when(F.col("hit").isNotNull(), "high").when(secret_name(F.col("name")) & live_secret(F.col("value")), "medium")
    shown = redacted(F.coalesce("hit.match", "value"))
    return named.select("key", "line", "name", level.alias("level"), F.coalesce("hit.shape", F.lit("live_value")).alias("what"), shown.alias("shown")).where("level is not null")


def reconciles(version: Column, pre: Column, kept: Column, dropped: Column, introduced: Column, post: Column) -> Column:
    """Whether a drop receipt's bytes add up: exactly from version 2 on; before, introduced bytes weren't known, so only as a lower bound."""
    counted = (pre >= 0) & (kept >= 0) & (dropped >= 0) & (pre == kept + dropped)
    return F.coalesce(counted & F.when(version >= 2, post == kept + introduced).otherwise(post >= kept), F.lit(False))
