"""Prompt, request and reply columns for model-function routes.

Everything is built with ``concat``/``struct``/``to_json``/``from_json``; the model
itself is a user function called on distinct texts (routes.call_model).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchantry import constants as K

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt texts (the model input must match them exactly)
# ---------------------------------------------------------------------------
FEWSHOT = (
    'Examples:\n'
    'Description: "McDonald\'s #111" -> {"canonical_merchant": "McDonald\'s", "category": "Food & Dining"}\n'
    'Description: "BP on Buford Hwy" -> {"canonical_merchant": "BP", "category": "Transportation"}\n'
    'Description: "Salary - Rush Hour" -> {"canonical_merchant": "Salary", "category": "Income"}\n'
    'Description: "HOME DEPOT #4521 ATLANTA GA" -> {"canonical_merchant": "Home Depot", "category": "Shopping & Retail"}\n'
    'Description: "SQ *CANES 47486" -> {"canonical_merchant": "Raising Cane\'s", "category": "Food & Dining"}\n'
)
FEWSHOT_HEAD = (
    "You standardize bank transactions. Strip store numbers, locations and noise "
    "to get the canonical merchant, and choose exactly one category.\n"
    "Ignore payment-processor prefixes (SQ*, TST*, PP*, PAYPAL*, SP*, "
    "POS DEBIT) and return the real merchant that follows them, using its proper "
    "brand spelling and capitalization.\n"
)
FINETUNE_HEAD = (
    "Standardize this bank transaction descriptor. Strip processor prefixes, "
    "store numbers, locations and noise to recover the real merchant in its "
    "proper brand spelling, and choose exactly one category.\n"
)
REPLY_RULE = 'Reply with ONLY a JSON object with keys "canonical_merchant" and "category".'
CATEGORY_QUESTION = "Which spending category does this bank transaction belong to?"
MERCHANT_QUESTION = "Which known merchant does this transaction description refer to?"
NONE_CRITERION = "None of the listed merchants is the one in the description"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_prompt(desc, categories=K.CATEGORIES) -> Column:
    """Few-shot generator prompt for one description."""
    return F.concat(F.lit(FEWSHOT_HEAD + f"Allowed categories: {', '.join(categories)}\n" + FEWSHOT
                          + 'Now do this one. Description: "'), _c(desc),
                    F.lit('"\n' + REPLY_RULE))


def finetune_prompt(desc, categories=K.CATEGORIES) -> Column:
    """The fine-tuned generator's prompt (raw descriptor)."""
    return F.concat(F.lit(FINETUNE_HEAD + f"Allowed categories: {', '.join(categories)}\n"
                          + 'Descriptor: "'), _c(desc), F.lit('"\n' + REPLY_RULE))


def json_str(c) -> Column:
    """A JSON string literal of a column (quotes and escapes)."""
    j = F.to_json(F.array(_c(c)))
    return j.substr(F.lit(2), F.length(j) - 2)


def to_example(desc, merchant, category, categories=K.CATEGORIES) -> Column:
    """One chat-format training record as JSON text."""
    answer = F.concat(F.lit('{"canonical_merchant": '), json_str(merchant),
                      F.lit(', "category": '), json_str(category), F.lit("}"))
    msgs = F.array(F.struct(F.lit("user").alias("role"), finetune_prompt(desc, categories).alias("content")),
                   F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
    return F.to_json(F.struct(msgs.alias("messages")))


REPLY_SCHEMA = "canonical_merchant string, category string"


def parse_response(reply) -> Column:
    """Greedy outermost ``{...}`` (dot matches newline) parsed as JSON; anything
    unparsable gives nulls. Returns struct(merchant, category)."""
    obj = F.nullif(F.regexp_extract(F.coalesce(_c(reply), F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    p = F.from_json(obj, REPLY_SCHEMA, {"mode": "PERMISSIVE"})
    return F.struct(p["canonical_merchant"].alias("merchant"), p["category"].alias("category"))


def choice_request(state, categories, candidates=None) -> Column:
    """Choice question over categories and, when candidates exist, over them plus
    ``none_of_these``. ``state`` is the prefix-stripped description only."""
    cats = F.map_from_arrays(F.array(*[F.lit(c) for c in categories]),
                             F.array(*[F.lit(None).cast("string") for _ in categories]))
    qs = [F.struct(F.lit("choice").alias("type"), F.lit(CATEGORY_QUESTION).alias("instructions"),
                   cats.alias("criteria")).alias("category")]
    if candidates is not None:
        cands = _c(candidates)
        crit = F.map_concat(
            F.map_from_arrays(cands, F.transform(cands, lambda _: F.lit(None).cast("string"))),
            F.create_map(F.lit(K.NONE_OPTION), F.lit(NONE_CRITERION)))
        qs.append(F.when(F.size(cands) > 0, F.struct(
            F.lit("choice").alias("type"), F.lit(MERCHANT_QUESTION).alias("instructions"),
            crit.alias("criteria"))).alias("merchant"))
    return F.struct(F.struct(_c(state).alias("description")).alias("state"),
                    F.struct(*qs).alias("questions"))


ANSWER_SCHEMA = ("answers map<string, struct<choice: string, confidence: double, "
                 "probabilities: map<string, double>>>, usage struct<input_tokens: bigint>")


def parse_choice(reply) -> Column:
    """Per question (merchant, category): choice, confidence, p_choice, p_none."""
    a = F.from_json(_c(reply), ANSWER_SCHEMA)

    def one(key):
        x = F.try_element_at(a["answers"], F.lit(key))
        probs = x["probabilities"]
        return F.struct(x["choice"].alias("choice"), x["confidence"].alias("confidence"),
                        F.try_element_at(probs, x["choice"]).alias("p_choice"),
                        F.try_element_at(probs, F.lit(K.NONE_OPTION)).alias("p_none"))
    return F.struct(one("merchant").alias("merchant"), one("category").alias("category"),
                    a["usage"]["input_tokens"].alias("input_tokens"))
