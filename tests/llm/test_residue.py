from tessera.llm.residue import answer_evidence, copied_bodies, find_residue, without_residue

SCHEMA = "doc_id long, title string, text string, source string, item_id string"


def docs(spark, texts, title="Great desk lamp", source="webshop"):
    return spark.createDataFrame([(i, title, t, source, f"IT-{i}") for i, t in enumerate(texts)], SCHEMA)


def found(spark, texts, **kwargs):
    return sorted(r.key for r in find_residue(docs(spark, texts, **kwargs)).collect())


SLOTS = [
    "Dear {{first_name}}, thank you.", "I bought the ${item.Color} last month.", "Use #{code} now.", "Hello <%= name %>, hi.", "The <?= $x ?> is fine.",
    "Use %(code)s now.", "My name is %s and I tested it.", "Bei %1$s gekauft.", "Ich habe [[marke]] gekauft.", "The <<enter order id>> is good.",
    "The ##PRODUCT## works.", "The @@Item@@ works.", "The __ITEM__ works.", "And *|COLOUR|* loves it.", "The $ITEM$ works.", "The %BRAND% works.", "Hi {0}, hello.",
    "Order «brand» today.", "Hallo [HIER VORNAME EINTRAGEN], danke.", "Hola <Insertar marca>, gracias.", "Everybody in *INSERT CITY HERE* likes it.",
    "The [first name] is nice.", "Comprei [CIDADE] em junho.", "Everybody in [enter item should own one.", "Dear &lt;colour&gt;, thanks.", "{ProductName} is good.",
]


def test_slots(spark):
    long_review = "It arrived in time and works well. " * 40
    assert found(spark, SLOTS) == list(range(len(SLOTS)))
    assert found(spark, [long_review + s for s in SLOTS]) == list(range(len(SLOTS)))


MENTIONS = [
    "The label software takes merge fields such as {{first_name}} and prints the real names.", "Array keys like [name] or [color] in the CSV import work as described.",
    "In the settings you type %NAME% where the name should appear.", "[UPDATE after two days] still fine.", "My old chair [not this brand] lasted longer.",
    "I give it 9/10 {just kidding, more like 8}.", "<3 <3 <3 this tent!", "I paid $20 instead of $25, that is 20% off.", "<p>Works well.</p><br/>",
]


def test_mentions_are_no_slots(spark):
    assert found(spark, MENTIONS) == []


NOTICES = [
    # Wordings of error pages, script notices and filler that were written for this test.
    "HTTP 410 Gone. The resource has been permanently deleted.", "Bad Request (400). Your browser sent a request that this server could not understand.", "Turn on JS to see this page.",
    "Bacon ipsum brisket ham hock pork loin.", "Die Seite konnte nicht geladen werden.", "Esta página no está disponible en este momento", "Dit artikel is tijdelijk niet beschikbaar",
    "The gateway timed out. Reload the page in a moment.", "Your session is no longer valid, please log in again.", "Access to this document is restricted in your country.",
    "Error 418: the server refused the connection", "Der Dienst ist derzeit überlastet. Bitte versuchen Sie es in wenigen Minuten erneut.", "Ihre Anfrage wurde vom Server blockiert.",
    "Le serveur est momentanément surchargé, veuillez réessayer plus tard.", "Ce contenu n'existe plus.", "No se pudo cargar el contenido. Inténtelo de nuevo más tarde.",
    "O serviço está indisponível. Tente novamente mais tarde.", "De pagina is verplaatst of verwijderd.", "Bitte schalten Sie Cookies und JavaScript in Ihrem Browser ein, aktivieren erforderlich.",
    "Este site precisa de JavaScript para funcionar.", "Cookies are disabled. Allow cookies and scripts to continue.", "Placeholder content, replace before you publish.",
    "Hier steht später ein Beispieltext.", "Insert the description here.", "Texte de remplissage provisoire.", "Dit is een testtekst, vervang deze tekst.",
    "Home | Shop | Cart\nThis content failed to load.", "<div>Access denied</div>", "qwerty qwerty qwerty", "Lorem ipsum dolor sit amet, consectetur elit.",
]


def test_notices(spark):
    assert found(spark, NOTICES) == list(range(len(NOTICES)))


REVIEWS = [
    "The mug says error 404: coffee not found, my sister uses it daily.", "Il a fallu activer JavaScript pour commander, ensuite tout allait bien.",
    "De site gaf eerst pagina niet gevonden, daarna lukte het bestellen.", "I bought the poster with lorem ipsum dolor sit amet printed on it and the kids laughed a lot.",
    "An internal server error ate my first review, so here it is again.", "The app needs a restart after a session has expired, otherwise no complaints.",
    "It works well and looks nice. 404 Not Found. I would buy it again at any time because it is great.", "ok", "", None, "good", "It does exactly what the page promised, nothing more and nothing less.",
]


def test_real_short_and_empty_texts_are_no_cases(spark):
    assert found(spark, REVIEWS) == []


def test_titles_do_not_count(spark):
    assert found(spark, ["A fine lamp for the desk."], title="404 Not Found {{name}}") == []


def test_very_long_text_is_read_to_its_end(spark):
    text = "A fine lamp for the desk, we use it daily. " * 20000
    assert found(spark, [text, text + "Dear {{name}}."]) == [1]


def test_nulls_everywhere_and_no_rows(spark):
    assert find_residue(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(None, None, None, None, None), (1, None, "lorem ipsum dolor sit", None, None), (None, None, "Dear {{x}}.", None, None)], SCHEMA)
    assert sorted((r.key is None, r.kind) for r in find_residue(df).collect()) == [(False, "notice"), (True, "slot")]


def test_remaining_records_keep_all_columns(spark):
    df = spark.createDataFrame([(1, "t", "Dear {{x}}.", "s", "i", 5, "k"), (2, "t", "Fine lamp.", "s", "i", 6, "k"), (2, "t", "Fine lamp.", "s", "i", 6, "k")], SCHEMA + ", key long, body string")
    out = without_residue(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [2, 2]


NO_RESIDUE = ["Great case. It does not need scripts or cookies.", "Very good [great] item", "Works with 100%s battery", "Call at 10:30_ish, worth 5:1_odds.", "Wow!!GREAT!!", "The error was in the manual, the page with the sizes is wrong."]


def test_reviews_near_the_grammar_are_no_cases(spark):
    assert found(spark, NO_RESIDUE) == []
    assert found(spark, ["Hello :first_name, great product", "Hi !!NAME!!, love it"]) == [0, 1]


def test_evidence_comes_with_every_row(spark):
    texts = ["Der Server antwortet nicht mehr."] * 3 + ["This page has expired."] + ["The lamp is fine, we use it daily."] * 2
    by_key = {r.key: r for r in find_residue(docs(spark, texts, title="Fine lamp")).collect()}
    assert set(by_key) == {0, 1, 2, 3}
    r = by_key[3]
    assert (r.kind, r.grammar, r.n_slugs, r.mismatch) == ("notice", 1.0, 1, 1.0) and r.score >= 3
    assert by_key[0].n_slugs == 3 and 0 < r.host_rate < 1


# The grammar knows none of these.
OTHER_WORDS = ["Backend returned an empty payload.", "Kein Zutritt ohne Ausweis.", "Kindly upgrade the wallet balance."]
ORDINARY = ["The lamp gives warm light.", "Die Lampe ist hell.", "No es cara.", "The box was dented.", "An empty shelf got a lamp.", "Very happy"]


def test_copied_answers_in_other_words_are_found_by_evidence(spark):
    texts = [t for t in OTHER_WORDS for _ in range(3)] + [t for t in ORDINARY for _ in range(3)] + ["502 Bad Gateway"]
    # Ordinary words stand in other reviews as well, copies or not.
    texts += [f"{a} {b}" for a in ORDINARY for b in ORDINARY if a != b] + [f"Lamp {i}, no empty box: {t}" for i, t in enumerate(ORDINARY)]
    result = {r.key: r.kind for r in find_residue(docs(spark, texts, title="Great desk")).collect()}
    assert result == {**{k: "response" for k in range(9)}, 27: "notice"}


def test_evidence_of_answers_equals_a_plain_count(spark):
    rows = [(1, "Red lamp", "The LAMP, 12 b3 is red!", "s", "X-1"), (2, "Blue", "the lamp is red", "s", "X-2"), (3, None, "The lamp  is red.", "s", "X-2"), (4, "Ok", "12 34", "s", None)]
    answers = answer_evidence(spark.createDataFrame(rows, SCHEMA))
    got = {r.key: r for r in answers.collect()}
    assert got[1].body == got[2].body == got[3].body != got[4].body
    assert [round(got[k].mismatch, 3) for k in (1, 2, 3, 4)] == [0.333, 1.0, 1.0, 1.0]
    assert [tuple(r)[1:] for r in copied_bodies(answers).collect()] == [(2, 3)]


def test_answers_in_other_words_need_copies_and_a_host_with_notices(spark):
    assert found(spark, OTHER_WORDS + ["502 Bad Gateway"]) == [3]
    assert found(spark, [OTHER_WORDS[0]] * 3 + ORDINARY) == []


BESIDE_MENTIONS = [
    "I bought this editor from {{store_name}} and use it daily.", "The settings of {{product_name}} are easy.", "The software was a gift for %BRAND% fans.",
    "The label software takes merge fields such as {{first_name}}, and the ${item.color} one is mine.", "Los campos de {{ciudad}} son bonitos.", "The import by [store name] took a week.",
]
GOVERNED = [
    "Array keys like [name] or\n[color] in the CSV import work as described.", "The placeholder {{name}} shows up in the preview.", "Les champs de fusion comme {{prenom}} marchent.",
    "The template replaces {{first_name}} with my name.", "In den Einstellungen tippt man %NAME% ein.", 'My template showed "{{name}}" once, support fixed it.',
]


def test_only_slots_that_the_sentence_talks_about_are_mentions(spark):
    assert found(spark, BESIDE_MENTIONS + GOVERNED) == list(range(len(BESIDE_MENTIONS)))


WIDE_SLOTS = [
    "Dear {{user-name}}, thanks.", "Dear {{#if name}}friend, thanks.", "Dear {{ name | default('friend') }}, thanks.", "The {{ product.name | upcase | strip }} works.",
    "The {{ order_items[0].name }} works.", "Dear ${user.name:-friend}, thanks.", "The <product-name> works.", "The [product-name] works.", "The {product-name} works.",
    "It came {% if order.shipping_method == 'express' and order.country in ['de', 'fr', 'nl'] %} fast.", "The {items[0]} works.", "The {name|upper} works.",
    "It cost <%= number_to_currency(order.total, unit: 'EUR', precision: 2, delimiter: '.', separator: ',') %>.", "It cost %(price).2f euros.",
]


def test_slots_with_filters_indexes_helpers_and_hyphens(spark):
    asides = ["My [brand-new] tent works.", "I paid {just kidding, more like 8}.", "Was 20%-off, now 30% less.", "A [well-made] bag.", "It is 5 <6 and 7-8 > 4."]
    assert found(spark, WIDE_SLOTS + asides) == list(range(len(WIDE_SLOTS)))


WRAPPED = [
    "Dear {{\n product_name\n}}, thanks.", "Dear <? echo $name ?>, thanks.", "Dear {% if a %}\nyou! {{ b }}\n{% endif %}", "Hello [insert your\nname], hi.",
    "The {{ name | default('you. Yes') }} works.", "See <a href=\"{{ shop_url }}\">the shop</a>.", "Order <%=\r\n order_id\r\n%> came.", "The <first\nname> is fine.",
]
LISTS = [
    "* Add more colours\n* Better box", "Pros [light\n\nCons: heavy] anyway.", "<ul><li>Works</li>\n<li class=\"a\">Cheap</li></ul>", "Width <\n 5 and more > 4.",
]


def test_slots_span_lines_and_sentence_ends(spark):
    assert found(spark, WRAPPED + LISTS) == list(range(len(WRAPPED)))
