"""Listings of one product and texts without content, on listings and texts of every dirty kind."""

import random
from itertools import combinations

import pytest

from wickerloom.llm.listings import one_edit, plain, read_listing
from wickerloom.llm.matching import correlate, group_pairs, product_groups
from wickerloom.llm.residue import fields, find_residue

LISTING = "item_index int, title string, features array<string>, description string, categories array<string>, group int, series string"


def listings(spark, rows):
    return spark.createDataFrame([(i, t, f, d, c, 0, "") for i, t, f, d, c in rows], LISTING)


def groups(spark, rows):
    return {r.item_index: r.group for r in product_groups(listings(spark, rows)).collect()}


def test_statements_in_any_wording():
    a = read_listing("Kelmor - Vantaro 150 Mk2 - 3.3 ft - 65 watts - set of 4 - USB-C cable - BLK", None, None)
    b = read_listing("USB-C cable ＶＡＮＴＡＲＯ-１５０ (generation 2)", ["Comes as 1 m", "Power: 65W", "(4 count) pack", "Colour: jet black", None, "Brand: Kelmor"], "It is the 65 W version.")
    assert a.anchors == b.anchors == [("vantaro", "150")] and b.brand == "kelmor"
    assert a.properties["generation"] == b.properties["generation"] == 2.0
    assert a.properties["pack"] == b.properties["pack"] and a.properties["colour"] == b.properties["colour"] == "black"
    assert abs(a.properties["length"] - b.properties["length"]) < 2
    assert read_listing("Vantaro 150 dock 8 potrs wite", [], "Note the 11.8 fl oz: volume as stated by the maker.").properties == {"ports": 8.0, "colour": "white", "volume": 348.967}
    assert read_listing("Vantaro 150 dock twellve potrs sinlge pack jet back", [], None).properties == {"pack": 1.0, "ports": 12.0, "colour": "black"}
    assert read_listing("Vantaro150 mouse #AB1234C", [], None).code == read_listing("Vantaro 150", ["MPN ab-1234c"], None).code == "ab1234c"
    assert read_listing(None, None, None).anchors == [] and plain("A&amp;B™  ﬁne") == "a&b fine"


def test_what_states_nothing():
    long = "The lid held up. " * 30 + "The second cable was 3 m, the first one shorter. Approx. 3.88 in. x 1.77 in. It is the 2 m version. " + "Good. " * 30
    assert read_listing("Vantaro 150 cable", [long, "Gold plated contacts", "Pairs with three devices", "1.77 in."], None).properties == {"length": 200.0}
    x = read_listing("Galaxy S21 5G USB 3 hub 7-in-1 1920x1080", None, None)
    assert x.anchors == [("galaxy", "s21")] and x.properties == {"ports": 7.0, "resolution": 1080.0}


ORDINARY = [
    ("xm4", "Sony WH-1000XM4 Wireless Noise Cancelling Headphones Black"), ("xm4", "Sony WH1000XM4 Bluetooth headphones (black)"), ("xm5", "Sony WH-1000XM5 Wireless Noise Cancelling Headphones Black"),
    ("10000", "Anker PowerCore 10000 Portable Charger"), ("20000", "Anker PowerCore 20000 Portable Charger"),
    ("3s", "Logitech MX Master 3S Wireless Mouse"), ("3s", "MX Master 3S by Logitech - performance mouse"), ("2s", "Logitech MX Master 2S Wireless Mouse"),
    ("13", "Apple iPhone 13 128GB Blue"), ("13", "iPhone 13 (128 GB) - blue - unlocked"), ("13 256", "Apple iPhone 13 256GB Blue"), ("13pro", "Apple iPhone 13 Pro 128GB Blue"),
    ("s21u", "Samsung Galaxy S21 Ultra 5G 256GB Phantom Black"), ("s21u", "Galaxy S21 Ultra 256 GB black smartphone Samsung"), ("s21", "Samsung Galaxy S21 5G 256GB Black"),
    ("qc45", "Bose QuietComfort 45 headphones"), ("qc45", "Bose QC45 Headphones wireless"), ("qc35", "Bose QuietComfort 35 headphones"),
    ("paper", "Kindle Paperwhite waterproof ereader signature edition"), ("paper", "Signature Edition Kindle Paperwhite e-reader waterproof"), ("grill", "Ninja Foodi smart grill indoor air fryer"),
    ("tcl", "TCL 40S325 40-inch 1080p Smart TV"), ("tcl", "TCL 40S325 Full HD television 40\""), ("tcl32", "TCL 32S325 32-inch 720p Smart TV"),
    ("brita", "Brita Marella XL water jug 3.5 l white"), ("brita", "Brita Marella XL Water Jug, White, 3.5 litres"), ("brita2", "Brita Marella XL water jug 2.4 l white"),
]


def test_ordinary_titles(spark):
    got = groups(spark, [(k, t, None, None, None) for k, (_, t) in enumerate(ORDINARY)])
    pairs = {(a, b) for a, b in combinations(range(len(ORDINARY)), 2) if got[a] == got[b]}
    want = {(a, b) for a, b in combinations(range(len(ORDINARY)), 2) if ORDINARY[a][0] == ORDINARY[b][0]}
    assert len(pairs & want) >= 0.9 * len(want) and len(pairs & want) >= 0.9 * len(pairs), [(ORDINARY[a][1], ORDINARY[b][1]) for a, b in pairs ^ want]


@pytest.mark.parametrize("a, b, want", [("abcd", "abcd", True), ("abcd", "abd", True), ("abcd", "abdc", True), ("abcd", "xbcd", True), ("abcd", "abcde", True), ("abcd", "badc", False), ("abcd", "abxy", False), ("", "a", True), ("abc", "cab", False)])
def test_one_edit(a, b, want):
    assert one_edit(a, b) == one_edit(b, a) == want


def test_products_are_grouped_across_wording_and_misspelling(spark):
    c = ["Electronics", "Cables"]
    rows = [
        (1, "Kelmor Vantaro 150 cable 1 m black", ["Brand: Kelmor"], None, c),
        (2, "BLK | Vantarro-150 | 3.3 ft", None, "Brand: Kelmor", None),
        (3, "Vnataro 150 cable by Kel-mor 100 cm", [None, ""], "", c),
        (4, "Kelmor Vantaro 150 cable 2 m black", ["Made by Kelmor"], None, c),
        (5, "Kelmor Vantaro 150 v2 cable 1 m black", [], None, c),
        (6, "Kelmor Vantaro 250 cable 1 m black", [], None, c),
        (7, None, None, None, None), (8, None, None, None, None), (9, "", [], "x" * 100_000, []),
        (10, "Kelmor Vantaro 150 cable 1 m black", ["Brand: Kelmor"], None, c),
    ]
    got = groups(spark, rows)
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 1}
    pairs = {(r.item_a, r.item_b) for r in group_pairs(product_groups(listings(spark, rows))).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 10), (2, 3), (2, 10), (3, 10)}


def test_very_long_titles(spark):
    name = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(3000))
    rows = [(1, f"{name} 40 lamp", None, None, None), (2, f"{name[:1500]}{name[1501:]} 40 lamp", None, None, None), (3, f"{name[::-1]} 40 lamp", None, None, None), (4, "lamp " * 200_000, None, None, None), (5, "y" * 1_000_000, None, None, None)]
    rows += [(100 + n, f"{name[:n]} 50 lamp", None, None, None) for n in range(56, 68)]
    got = groups(spark, rows)
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5} | {100 + n: 156 for n in range(56, 68)}


def test_many_copies_and_an_empty_catalogue(spark):
    rows = [(k, f"Zubrin Kalvero {70 if k % 2 else 90} mug 350 ml", None, None, None) for k in range(400)]
    assert groups(spark, rows) == {k: k % 2 for k in range(400)}
    assert groups(spark, []) == {}


def test_misspelt_series_meet_in_wide_windows(spark):
    names = [a + b + c for a in ("bal", "dor", "fen", "guk") for b in ("mir", "nor", "pel") for c in ("ta", "vin", "zor")]
    rows = [(k, f"{n} 40 lamp", None, None, None) for k, n in enumerate(names)]
    rows += [(1000 + k, f"{n[:4]}{n[5]}{n[4]}{n[6:]} 40 lamp", None, None, None) for k, n in enumerate(names)]
    got = groups(spark, rows)
    assert all(got[1000 + k] == k for k in range(len(names)))


def test_a_misspelling_far_from_its_name_in_every_order(spark):
    dice = random.Random(7)
    some = lambda n, letters: "".join(dice.choices(letters, k=n))
    names = {"kelmirbvostan": 0, "kelmiryvostan": 1}  # the letter that differs has many names between on either side
    for k in range(80):
        names["kelmir" + some(1, "cdefghijklmnopqrstuvwx") + some(6, "bcdfghjkl")] = 10 + k
        names[some(6, "bcdfghjkl") + some(1, "cdefghijklmnopqrstuvwx") + "vostan"] = 100 + k
        names["abc" + some(9, "defghij")] = 200 + k
    assert [(a, b) for a, b in combinations(names, 2) if one_edit(a, b)] == [("kelmirbvostan", "kelmiryvostan")]
    got = groups(spark, [(k, f"{n} 40 lamp", None, None, None) for n, k in names.items()])
    assert got == {k: k if k != 1 else 0 for k in names.values()}


def test_names_of_one_edit_meet_whatever_their_lengths(spark):
    rows = [(1, "Vantar 40 lamp", None, None, None), (2, "Vanta 40 lamp", None, None, None), (3, "Zelmo 40 lamp", None, None, None), (4, "Zelma 40 lamp", None, None, None)]
    assert groups(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_titles_without_series_meet_by_their_words(spark):
    fill = [(k, f"aa{k % 26 * 'b'}xx kettle yy{k % 7 * 'c'}zz mm{k % 11 * 'd'}nn handle", None, None, None) for k in range(10, 90)]
    rows = [(1, "quiet stovetop kettle handle polished", None, None, None), (2, "kettle handel qiet polishd stovtop", None, None, None), (3, "kettle handle quiet polished", None, None, None), (4, "kettle handle", None, None, None)]
    got = groups(spark, rows + fill)
    assert got[1] == got[2] == got[3] == 1 and got[4] == 4 and 1 not in [got[k] for k, *_ in fill]


def test_a_shared_code_alone_joins_no_strangers(spark):
    rows = [(1, "Vantaro 150 dock #AB1234C", None, None, None), (2, "Xaolwakor 150 dock AB 1234C", None, None, None), (3, "Vntaaro 150 dock (AB/1234C)", None, None, None)]
    assert groups(spark, rows) == {1: 1, 2: 2, 3: 1}


def test_clusters_hold_no_contradiction():
    s = [(1, "ab1a", "", {"colour": "black"}), (2, "ab1b", "", {"colour": "red"}), (3, "", "", {"colour": "red", "pack": 2.0}), (4, "ab1a", "", {}), (5, "", "", {"pack": 3.0, "colour": "red"})]
    s = sorted(s, key=lambda x: (not x[1], -len(x[3]), x[0]))
    got = dict(zip([x[0] for x in s], correlate(iter(x[1:] for x in s))))
    assert got[1] == got[4] != got[2] == got[3] != got[5] and got[5] != got[2]


REAL = "The lid held up well and the cable is long enough. I would buy it again for the kitchen. It took four minutes to set up."
CASES = [
    ("Dear {{first_name}}, thanks.", "template"), ("Only <%= price %> dollars", "template"), ("It costs undefined dollars today.", "template"), (REAL + " The [object Object] is fine.", "template"), ("For &lt;PRICE&gt; euros", "template"),
    ("Weighs %1$s here", "template"), ("Week ________ it broke", "template"), ("Le modèle XXXX tient bien.", "template"), ("[INSERT COUNT HERE] units", "template"), ("The __list_price__ is low", "template"), ("Hello *|NAME|*", "template"),
    ("Home > Shop > dock\n404 Not Found\nBack to homepage", "error"), ("Title: Vantaro Kelmor\nAn unexpected error occurred (code 217).\n© all rights reserved", "error"), ("Zugriff verweigert.", "error"), ("ACCESS DENIED. YOU DO NOT HAVE PERMISSION TO VIEW THIS ITEM.", "error"),
    ("Please enable JavaScript to view this page.", "script"), ("Menu  Cart (0)  Sign in\nScripts are blocked. Allow them and reload.", "script"),
    ("Lorem ipsum dolor sit amet. Consectetur adipiscing elit.", "filler"), ("Your text here. Your text here.", "filler"), ("TBD", "filler"), ("n/a n/a n/a", "filler"),
    (REAL, None), (REAL + " Error loading related products.", None), (REAL + " The router page shows '404 Not Found' when I open the setup link.", None), (REAL + " It needs a null modem adapter.", None), ("Undefined behaviour: both LEDs blink at once. " + REAL, None),
    ("Slots are marked [A], [B] and [C]. Press [Enter]. The keys type { and } too.", None), ("Names are <first> <last>, odd but harmless.", None), ("Save 20% now, 100% happy, $4.50 [with coupon], now $3.", None), ("A blank line ____ for the signature.", None),
    ('My config is {"mode": "eco", "level": 3}.', None), ("Warning label #169: XX-188 is the model.", None), ("Todo el mundo lo usa.", None), (None, None), ("  \n ", None), ("Works great", None), ("<p>Good cable.</p><p>Long one.</p>", None),
]


def test_residue_is_told_from_texts_that_speak_of_it(spark):
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(CASES)], "doc_id long, text string, label string")
    got = {r.doc_id: r.label for r in find_residue(df).collect()}
    assert {CASES[k][0]: v for k, v in got.items() if v != CASES[k][1]} == {}
    assert len(got) == len(CASES) and find_residue(df.filter("false")).collect() == []


@pytest.mark.parametrize("text", ["Your parcel [order_id] left.", "Part {product_id} fits.", "See %tracking_code% for it.", "Ask <support_team> first.", "Costs $shipping_fee$ more.", "Ref ~batch_no~ here", "The __delivery_window__ ends", "From [warehouseName] with care.", "Code {orderId} or [OrderID]", "Pay <GRAND_SUM> now"])
def test_fields_are_known_by_the_form_of_their_name(text):
    assert fields(text)


@pytest.mark.parametrize("text", ["Use row[max_len] there.", "On [iPhone] and <eBay>, [YouTube] too.", "See [user_guide](page) for it.", "[solved] The <first> <last> of [A], then press [Enter].", "The {set} and ~ten~ of [sic].", "snake_case and camelCase are styles", "Runs on [macOS]."])
def test_ordinary_text_in_brackets_is_no_field(text):
    assert not fields(text)


def test_long_and_repeated_texts(spark):
    long = (REAL + "\n") * 3000
    df = spark.createDataFrame([(1, long), (2, long + " {{price}}"), (3, "404 Not Found"), (3, "404 Not Found")], "doc_id long, text string")
    assert sorted((r.doc_id, r.label or "") for r in find_residue(df).collect()) == [(1, ""), (2, "template"), (3, "error"), (3, "error")]
