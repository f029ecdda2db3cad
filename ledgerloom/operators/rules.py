"""Keyword rules, known people and rules learned from verified labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.thresholds import TRUSTED, VERIFIED, Thresholds

#: Keyword rules in the order in which they are tried: patterns, category, subcategory,
#: merchant, tags; rules marked "description" don't look at the note.
KEYWORD_RULES: list[tuple] = [
    (["swiggy"], "Food & Dining", "Food Delivery", "Swiggy", ["food"]),
    (["zomato"], "Food & Dining", "Food Delivery", "Zomato", ["food"]),
    (["instamart"], "Food & Dining", "Food Delivery", "Swiggy Instamart", ["grocery"]),
    (["bigbasket", "big basket"], "Food & Dining", "Groceries", "BigBasket", ["grocery"]),
    (["blinkit", "grofers"], "Food & Dining", "Groceries", "Blinkit", ["grocery"]),
    (["zepto"], "Food & Dining", "Groceries", "Zepto", ["grocery"]),
    (["dmart", "d-mart"], "Food & Dining", "Groceries", "DMart", ["grocery"]),
    (["starbucks"], "Food & Dining", "Cafe & Snacks", "Starbucks", ["coffee"]),
    (["cafe coffee day", "ccd"], "Food & Dining", "Cafe & Snacks", "Cafe Coffee Day", ["coffee"]),
    (["dominos", "domino's"], "Food & Dining", "Restaurants", "Domino's", ["food"]),
    (["mcdonald", "mcdonalds"], "Food & Dining", "Restaurants", "McDonald's", ["food"]),
    (["kfc"], "Food & Dining", "Restaurants", "KFC", ["food"]),
    (["amazon", "amzn"], "Shopping", "Online Shopping", "Amazon", ["shopping"]),
    (["flipkart"], "Shopping", "Online Shopping", "Flipkart", ["shopping"]),
    (["myntra"], "Shopping", "Clothing & Apparel", "Myntra", ["shopping", "clothing"]),
    (["meesho"], "Shopping", "Online Shopping", "Meesho", ["shopping"]),
    (["ajio"], "Shopping", "Clothing & Apparel", "AJIO", ["shopping", "clothing"]),
    (["nykaa"], "Shopping", "General Retail", "Nykaa", ["shopping", "beauty"]),
    (["uber"], "Transport", "Cab & Auto", "Uber", ["transport"]),
    (["ola", "olacabs", "ola cabs"], "Transport", "Cab & Auto", "Ola", ["transport"]),
    (["rapido"], "Transport", "Cab & Auto", "Rapido", ["transport"]),
    (["irctc"], "Travel", "Train", "IRCTC", ["travel", "train"]),
    (["indigo", "air india", "spicejet", "akasa", "vistara", "go first"], "Travel", "Flights", None, ["travel", "flight"]),
    (["makemytrip", "mmt"], "Travel", None, "MakeMyTrip", ["travel"]),
    (["goibibo"], "Travel", None, "Goibibo", ["travel"]),
    (["redbus"], "Travel", "Bus", "redBus", ["travel", "bus"]),
    (["petrol", "petroleum", "hp petrol", "indian oil", "iocl", "bharat petroleum", "bpcl", "hpcl"], "Transport", "Fuel", None, ["fuel"]),
    (["jio", "reliance jio"], "Bills & Utilities", "Mobile Recharge", "Jio", ["telecom"]),
    (["airtel"], "Bills & Utilities", "Mobile Recharge", "Airtel", ["telecom"]),
    (["vodafone", "idea cellular", "vodafone idea", "vi recharge"], "Bills & Utilities", "Mobile Recharge", "Vi", ["telecom"]),
    (["bsnl"], "Bills & Utilities", "Mobile Recharge", "BSNL", ["telecom"]),
    (["tata sky", "dish tv", "sun direct", "videocon d2h", "d2h"], "Bills & Utilities", "DTH", None, ["dth"]),
    (["bescom", "msedcl", "tneb", "tata power", "adani electricity", "electricity bill"], "Bills & Utilities", "Electricity", None, ["electricity"]),
    (["netflix"], "Entertainment", "Movies & OTT", "Netflix", ["ott"]),
    (["hotstar", "disney+", "disney plus"], "Entertainment", "Movies & OTT", "Hotstar", ["ott"]),
    (["spotify"], "Entertainment", "Movies & OTT", "Spotify", ["music"]),
    (["youtube premium", "youtube music"], "Entertainment", "Movies & OTT", "YouTube Premium", ["ott"]),
    (["amazon prime", "prime video"], "Entertainment", "Movies & OTT", "Amazon Prime", ["ott"]),
    (["sonyliv", "sony liv"], "Entertainment", "Movies & OTT", "SonyLIV", ["ott"]),
    (["zee5"], "Entertainment", "Movies & OTT", "ZEE5", ["ott"]),
    (["bookmyshow"], "Entertainment", "Events & Concerts", "BookMyShow", ["entertainment"]),
    (["salary", "sal cr", "sal credit"], "Income", "Salary", None, ["income", "salary"], "description"),
    (["mutual fund", "mf sip", "sip debit", "nfo"], "Investments", "Mutual Fund SIP", None, ["investment"]),
    (["emi", "loan emi", "home loan", "car loan", "personal loan"], "Finances", "Loan EMI", None, ["emi"]),
    (["insurance", "lic", "hdfc life", "sbi life", "icici pru"], "Finances", "Insurance Premium", None, ["insurance"]),
    (["credit card", "cc payment", "card outstanding"], "Finances", "Credit Card Payment", None, ["credit-card"]),
    (["income tax", "tds payment", "advance tax", "gst payment"], "Finances", "Tax Payment", None, ["tax"]),
    (["int.pd", "interest paid", "interest credit"], "Income", "Interest & Dividends", None, ["interest"], "description"),
    (["indmoney", "ind money"], "Investments", "Mutual Fund SIP", "INDmoney", ["investment"]),
    (["nach-mut-dr", "nach mut dr"], "Investments", "Mutual Fund SIP", None, ["investment", "sip"]),
    (["groww"], "Investments", "Mutual Fund SIP", "Groww", ["investment"]),
    (["zerodha", "coin by zerodha"], "Investments", "Mutual Fund SIP", "Zerodha", ["investment"]),
    (["kuvera"], "Investments", "Mutual Fund SIP", "Kuvera", ["investment"]),
    (["atm withdrawal", "atm cash", "atm wd"], "Transfers", "ATM Withdrawal", None, ["cash"]),
    (["neft", "rtgs", "imps"], "Transfers", "Peer Transfer", None, ["transfer"], "description"),
    (["irctctourism"], "Transport", "Public Transport", "IRCTC Tourism", ["transport", "metro"]),
    (["maha mumbai met", "mumbai metro"], "Transport", "Public Transport", "Mumbai Metro", ["transport", "metro"]),
    (["uts- direct", "uts-direct"], "Transport", "Public Transport", "UTS", ["transport", "train"]),
    (["pharmeasy", "netmeds", "1mg", "medplus", "apollo pharmacy"], "Health", "Pharmacy", None, ["health", "pharmacy"]),
    (["apollo hospital", "fortis", "max hospital", "manipal", "aiims"], "Health", "Doctor & Hospital", None, ["health", "hospital"]),
    (["cult.fit", "cult fit", "curefit"], "Personal Care", "Gym & Fitness", "Cult.fit", ["fitness"]),
    (["urban company", "urbanclap"], "Personal Care", "Salon & Spa", "Urban Company", ["personal-care"]),
    (["coursera", "udemy", "udacity", "unacademy", "byju", "upgrad"], "Education", "Online Courses", None, ["education"]),
    (["school fee", "college fee", "tuition fee"], "Education", "Tuition & Fees", None, ["education"]),
    (["rent payment", "house rent", "rental"], "Housing", "Rent", None, ["rent"]),
    (["maintenance", "society charges", "society fee"], "Housing", "Maintenance & Society Charges", None, ["housing"]),
]
#: A rule that holds if a base and an override pattern occur; tried before the keyword rules.
DISAMBIGUATION_RULES: list[tuple] = [
    (["uber", "ubereats"], ["eat", "eats", "food", "ubereats"], "Food & Dining", "Food Delivery", "Uber Eats", ["food"]),
    (["amazon", "amzn"], ["prime video", "primevideo", "prime membership"], "Entertainment", "Movies & OTT", "Amazon Prime", ["ott"]),
    (["amazon", "amzn"], ["aws", "amazon web"], "Finances", None, "AWS", ["business", "cloud"]),
]
RULE_CONFIDENCE = 0.95
#: Rule tables. kind is "keyword" (one of a rule's patterns suffices), or "base" and "override" (one of each is needed);
#: field is "description" for a pattern that doesn't look at the note.
PATTERNS = "rule_order int, pattern string, kind string, field string"
LABELS = "rule_order int, category string, subcategory string, merchant string, tags array<string>, confidence double"
_TOKEN = r"(?U)\w+|\W"


def default_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed rules as tables: patterns and labels."""
    patterns, labels = [], []
    for n, (base, override, *label) in enumerate(DISAMBIGUATION_RULES):
        patterns += [(n, p, "base", None) for p in base] + [(n, p, "override", None) for p in override]
        labels.append((n, *label, RULE_CONFIDENCE))
    for n, (words, *label) in enumerate(KEYWORD_RULES, len(labels)):
        patterns += [(n, p, "keyword", "description" if len(label) > 4 else None) for p in words]
        labels.append((n, *label[:4], RULE_CONFIDENCE))
    return spark.createDataFrame(patterns, PATTERNS), spark.createDataFrame(labels, LABELS)


def _tokens(text: Column) -> Column:
    """Words, and every other character by itself."""
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def _is_word(token: Column) -> Column:
    return F.coalesce(token.rlike(r"(?U)^\w"), F.lit(False))


def rule_of_text(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """The first rule that holds for each of ``texts(description, note)``: these and rule_order.

    A pattern holds where its words stand whole, without case. Patterns and texts are cut
    into tokens; a pattern of n tokens is found by equality among the texts' runs of n, so the
    work grows with the texts and the matches, not with the number of rules. Which n
    there are is all that the driver learns of the rules. Patterns without a character
    other than spaces hold nowhere; spaces at a pattern's ends don't count. A null kind is
    "keyword". ``texts`` are distinct.
    """
    index = patterns.select("rule_order", F.coalesce("kind", F.lit("keyword")).alias("kind"), (F.col("field") == "description").alias("narrow"), F.lower(F.trim("pattern")).alias("gram"))
    index = index.where("gram <> ''").withColumn("_t", _tokens(F.col("gram")))
    index = index.select("rule_order", "kind", F.coalesce("narrow", F.lit(False)).alias("narrow"), "gram", F.size("_t").alias("n"), (~_is_word(F.element_at("_t", 1))).alias("opens"), (~_is_word(F.element_at("_t", -1))).alias("ends"))
    lengths = sorted(r.n for r in index.select("n").distinct().collect())
    described = F.lower(F.coalesce("description", F.lit("")))
    cut = texts.select("description", "note", _tokens(F.concat(described, F.lit(" "), F.lower(F.coalesce("note", F.lit(""))))).alias("_w"), F.size(_tokens(described)).alias("_k"))

    def runs(n: int) -> Column:
        def run(i: Column) -> Column:
            gram = F.element_at("_w", i) if n == 1 else F.array_join(F.slice("_w", i, n), "")
            return F.struct(gram.alias("gram"), (i + n - 1 <= F.col("_k")).alias("inside"), _is_word(F.get("_w", i - 2)).alias("before"), _is_word(F.get("_w", i + n - 1)).alias("after"))

        starts = F.filter(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: F.element_at("_w", i) != " ")
        return F.when(F.size("_w") >= n, F.transform(starts, run))

    every = F.flatten(F.array_compact(F.array(*map(runs, lengths)))) if lengths else F.array()
    found = cut.select("description", "note", F.explode(F.array_distinct(every)).alias("_r")).select("description", "note", "_r.*") if lengths else None
    if found is None:
        return texts.select("description", "note", F.lit(None).cast("int").alias("rule_order")).limit(0)
    hits = found.join(index, "gram").where("not (opens and before) and not (ends and after) and (inside or not narrow)")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("rule_order"))
    grouped = hits.groupBy("description", "note").agg(F.min(of("keyword")).alias("k"), F.collect_set(of("base")).alias("b"), F.collect_set(of("override")).alias("o"))
    return grouped.select("description", "note", F.least("k", F.array_min(F.array_intersect("b", "o"))).alias("rule_order")).where("rule_order is not null")


def match_keyword_rules(txns: DataFrame, patterns: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """``label`` of each transaction by the first rule that holds, null if none does.

    ``patterns`` and ``labels`` are tables like those of ``default_rules``, which they
    default to; a rule without a label gives none. Descriptions repeat but for their reference
    number, so each distinct (description without reference, note) is matched once.
    """
    if patterns is None or labels is None:
        patterns, labels = (given if given is not None else default for given, default in zip((patterns, labels), default_rules(txns.sparkSession), strict=True))
    slim = txns.withColumn("_desc", S.strip_upi_ref(F.col("raw_description")))
    rule = rule_of_text(slim.select(F.col("_desc").alias("description"), "note").distinct(), patterns)
    said = labels.select("rule_order", F.struct("category", "subcategory", "merchant", "tags", "confidence", F.lit("rule").alias("source")).alias("label"))
    named = rule.join(said, "rule_order").select(F.col("description").alias("_d"), F.col("note").alias("_n"), "label")
    return slim.join(named, slim["_desc"].eqNullSafe(named["_d"]) & slim["note"].eqNullSafe(named["_n"]), "left").drop("_desc", "_d", "_n")


def match_disambiguation_rules(txns: DataFrame, patterns: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The same by the rules alone that need a base and an override pattern."""
    patterns = default_rules(txns.sparkSession)[0] if patterns is None else patterns
    return match_keyword_rules(txns, patterns.where(F.col("kind").isin("base", "override")), labels)


def match_people(txns: DataFrame, people: DataFrame) -> DataFrame:
    """The known person of each transaction: id, person_id, name, subcategory; the first by name wins.

    A token with "@" is a handle: equal to the row's, or inside the description of a row
    without one. Other tokens begin a word of the counterparty key, or of the description
    where there is no key. Handles and word prefixes are joined by equality. What must
    lie inside a description is found by equality too: the distinct descriptions' runs of three
    characters meet the tokens that begin with them, and each such pair is tested.
    """
    tokens = people.select("ledger_id", F.col("id").alias("person_id"), "name", "relationship", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("upi")))).alias("token")).where("length(token) >= 3")
    at = F.col("token").contains("@")
    rows = txns.select("ledger_id", "id", F.lower("raw_description").alias("desc"), F.lower("vpa").alias("vpa"), F.lower(F.coalesce("counterparty_key", S.counterparty_key(F.col("raw_description")))).alias("key"))
    by_vpa = rows.where("vpa is not null").join(tokens.where(at), (rows.ledger_id == tokens.ledger_id) & (F.col("vpa") == F.col("token"))).select(rows.ledger_id, "id", "person_id", "name", "relationship")
    words = rows.where("key is not null").select("ledger_id", "id", F.explode(F.array_distinct(F.split("key", " "))).alias("word")).where("length(word) >= 3")
    prefixes = words.select("ledger_id", "id", F.explode(F.transform(F.sequence(F.lit(3), F.length("word")), lambda n: F.substr("word", F.lit(1), n))).alias("token"))
    by_word = prefixes.join(tokens.where(~at), ["ledger_id", "token"]).select("ledger_id", "id", "person_id", "name", "relationship")
    # every token has a run of three characters that a text which holds it has too
    gram = tokens.withColumn("gram", F.substring("token", 1, 3))

    def held(left: DataFrame, right: DataFrame, test: Column) -> DataFrame:
        texts = left.select("ledger_id", "desc").distinct()
        runs = texts.select("ledger_id", "desc", F.explode(S.grams(F.col("desc"), 3)).alias("gram"))
        met = runs.join(right, ["ledger_id", "gram"]).where(test).select("ledger_id", "desc", "person_id", "name", "relationship").distinct()
        return left.join(met, ["ledger_id", "desc"]).select("ledger_id", "id", "person_id", "name", "relationship")

    handle_inside = held(rows.where("vpa is null and contains(desc, '@')"), gram.where(at), F.col("desc").contains(F.col("token")))
    begins = F.expr(r"desc rlike concat('(?U)\\b', regexp_replace(token, '([^a-z0-9_ ])', '\\\\$1'))")
    name_inside = held(rows.where("key is null"), gram.where(~at), begins)
    found = by_vpa.union(by_word).union(handle_inside).union(name_inside)
    first = found.groupBy("id").agg(F.min_by(F.struct("person_id", "name", "relationship"), F.struct("name", "person_id")).alias("p"))
    return first.select("id", "p.person_id", "p.name", S.relationship_subcategory(F.col("p.relationship")).alias("subcategory"))


def learned_rules(rows: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Counterparties whose verified labels agree: the label of the latest of them."""
    verified = rows.where(F.col("source").isin(*VERIFIED) & F.col("counterparty_key").isNotNull() & F.col("category").isNotNull())
    keys = ["ledger_id", "counterparty_key"]
    latest = F.max_by(F.struct("subcategory", "merchant", "tags"), F.struct("annotated_at", "id")).alias("rep")
    by_category = verified.groupBy(*keys, "category").agg(F.count("*").alias("support"), latest)
    best = by_category.groupBy(*keys).agg(F.sum("support").alias("total"), F.min_by(F.struct("category", "support", "rep"), F.struct(-F.col("support"), F.col("category"))).alias("b"))
    out = best.select(*keys, "b.category", "b.rep.subcategory", "b.rep.merchant", "b.rep.tags", "b.support", "total")
    purity = F.col("support") / F.col("total")
    return out.where((F.col("support") >= th.learned_support) & (purity >= th.learned_purity)).withColumn("purity", F.round(purity.cast("decimal(28,8)"), 4).cast("double"))


def apply_suppressions(rules: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Rules whose counterparty nobody dismissed; dismissals may repeat."""
    return rules.join(suppressed.select("ledger_id", "counterparty_key").distinct(), ["ledger_id", "counterparty_key"], "left_anti")


def edit_suppressions(suppressed: DataFrame, dismiss: DataFrame, restore: DataFrame) -> DataFrame:
    """Dismissals after a batch of new ones and of restored keys; idempotent."""
    keys = ["ledger_id", "counterparty_key"]
    return suppressed.select(*keys).union(dismiss.select(*keys)).distinct().join(restore.select(*keys).distinct(), keys, "left_anti")


def _standing(rows: DataFrame, label: Column, weight: Column) -> DataFrame:
    """What the labels of a counterparty say before each of its days: keys, day, n, mass, kinds, best(w, category).

    Labels are summed by day and category first, so a hot counterparty leaves a row for
    each day and category. A category's running weight never falls, so the leader before
    a day is the largest of all running weights on earlier days (ties: the first by name),
    and one frame over the days finds it with n, mass and the number of categories. No
    list of categories is needed. Days on which no label stands before are left out.
    """
    keys = ["ledger_id", "counterparty_key"]
    day = F.datediff("txn_date", F.lit("1970-01-01").cast("date")).alias("day")
    keyed = rows.where("counterparty_key is not null").select(*keys, day, label.alias("label"), weight.cast("double").alias("weight"))
    daily = keyed.groupBy(*keys, "day", "label").agg(F.count("label").alias("n"), F.sum("weight").alias("w"))
    running = Window.partitionBy(*keys, "label").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    named = F.col("label").isNotNull()
    events = daily.select(*keys, "day", "n", F.when(named, F.col("w")).otherwise(0.0).alias("w"), F.when(named & (F.row_number().over(running.rowsBetween(Window.unboundedPreceding, 0)) == 1), 1).otherwise(0).alias("new"), F.when(named, F.struct((-F.sum("w").over(running)).alias("w"), F.col("label").alias("category"))).alias("lead"))
    earlier = Window.partitionBy(*keys).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    known = events.select(*keys, "day", F.sum("n").over(earlier).alias("n"), F.sum("w").over(earlier).alias("mass"), F.sum("new").over(earlier).alias("kinds"), F.min("lead").over(earlier).alias("best"))
    return known.where("n > 0").dropDuplicates([*keys, "day"])


def _with_standing(rows: DataFrame, label: Column, weight: Column) -> DataFrame:
    keyed = rows.where("counterparty_key is not null").select("ledger_id", "id", "counterparty_key", F.datediff("txn_date", F.lit("1970-01-01").cast("date")).alias("day"))
    return keyed.join(_standing(rows, label, weight), ["ledger_id", "counterparty_key", "day"])


def learned_rule_asof(rows: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """The learned rule that stood before each row's day, or none; any category counts."""
    label = F.when(F.col("source").isin(*VERIFIED), F.col("category"))
    support = (-F.col("best.w")).cast("long")
    found = _with_standing(rows, label, F.lit(1.0)).select("ledger_id", "id", "counterparty_key", F.col("best.category").alias("category"), support.alias("support"), F.col("n").alias("total"))
    return found.where((F.col("support") >= th.learned_support) & (F.col("support") / F.col("total") >= th.learned_purity))


def counterparty_prior(rows: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """What a counterparty's earlier labels say about each row: n, weight, winner, probability, established.

    Labels of strictly earlier days count, trusted ones in full, machine ones by
    ``machine_weight``; categories are whatever the labels hold.
    """
    weight = F.when(F.col("source").isin(*TRUSTED), 1.0).otherwise(th.machine_weight)
    found = _with_standing(rows, F.col("category"), weight)
    p = (th.prior_weight / F.col("kinds") - F.col("best.w")) / (th.prior_weight + F.round("mass", 4))
    out = found.select("ledger_id", "id", "counterparty_key", F.col("n").alias("n_prior"), F.round("mass", 4).alias("weight"), F.col("best.category").alias("category"), F.round(p.cast("decimal(28,8)"), 4).cast("double").alias("probability"))
    return out.withColumn("established", (F.col("n_prior") >= th.prior_min_obs) & (F.col("probability") >= th.prior_dominance))
