from conftest import one_col
from merchantry.functions import text as T


def test_strip_processor_prefix(spark):
    cases = {
        "SQ *COFFEE": "COFFEE", "PAYPAL *CAPITAL ONE": "CAPITAL ONE",
        "POS DEBIT WALMART": "WALMART", "PURCHASE DIRECT DEPOSIT": "DIRECT DEPOSIT",
        "PP*CAPITALGAINS": "CAPITALGAINS", "PP*DOUGHNOTTS": "DOUGHNOTTS",
        "POSDEBITMATERNITY": "POSDEBITMATERNITY", "ACHILLES SHOES": "ACHILLES SHOES",
        "PURCHASED GOODS LTD": "PURCHASED GOODS LTD", "ACH ELECTRIC CO": "ELECTRIC CO",
        "AMZNMktplace": "AMZNMktplace", "AMZNMKTPLACE AMAZO": "AMZNMKTPLACE AMAZO",
        "AMZN Mktp UK*MI5TU": "AMZN Mktp UK*MI5TU", "AMZN MKTP UK AMAZO": "AMZN MKTP UK AMAZO",
        "McDonald's #111": "McDonald's #111", "ACH\tFOO": "FOO", "ACH": "",
    }
    assert one_col(spark, list(cases), T.strip_processor_prefix) == list(cases.values())


def test_clean_description(spark):
    cases = {"McDonald's #111": "mcdonald's", "UCLA Medical TXN176162": "ucla medical",
             "  BP   on   Buford  ": "bp on buford", "Disney+ #2115": "disney+"}
    assert one_col(spark, list(cases), T.clean_description) == list(cases.values())


def test_derive_canonical(spark):
    cases = {
        "UCLA Medical #7731 - UK Center TXN176162": "UCLA Medical",
        "Starbucks - AUSTRALIA Store - Evening": "Starbucks",
        "Tim Hortons #1434 Branch (App)": "Tim Hortons",
        "Walmart Pharmacy Shopping Center": "Walmart Pharmacy",
        "Burlington Store Branch Hospital": "Burlington",
        "Hospital Airport": "Hospital",
        "Children's Hospital Airport": "Children's Hospital",
        "Online Bank Store": "Online Bank",
        "Bank Online": "Bank",
        "Senior Center #12 Airport": "Senior Center",
        "holiday pay - usa": "Holiday Pay",
        "Donation Hospital": "Donation",
    }
    assert one_col(spark, list(cases), T.derive_canonical) == list(cases.values())


def test_norm_and_tokens(spark):
    assert one_col(spark, ["McDonald's", "H&M", None], T.norm_merchant) == ["mcdonalds", "hm", ""]
    toks = one_col(spark, ["The Home Depot", "M&S", "Macy's Backstage"], T.name_tokens)
    assert [sorted(t) for t in toks] == [["depot", "home"], ["m", "s"], ["backstage", "macy"]]


def test_abbreviate(spark):
    cases = {"BLUE HERON BAKERY": "BLUE HRN BKRY", "ACME OAK ELM": "ACME OAK ELM",
             "ORCHARD": "ORCHRD"}
    assert one_col(spark, list(cases), T.abbreviate) == list(cases.values())


def test_letter_counts(spark):
    v = one_col(spark, ["Abba"], T.letter_counts)[0]
    assert v[0] == 2 and v[1] == 2 and sum(v) == 4
