"""Residue in wordings, languages and syntaxes that no exemplar has, beside real texts on the same subjects."""

import pytest
from pyspark.sql import functions as F

from wickerloom.llm.residue import fields, find_residue

RESIDUE = """
Oops, that page has gone missing.
Bad request. The server could not understand your request.
Product information will be added shortly.
You must switch on JS in your browser settings to view this shop.
The page you were looking for doesn't exist.
Whoops! Nothing found at this address.
Error 404. The requested page could not be located on this server.
Sorry, you are not authorised to access this page.
Your session timed out. Log in again to continue.
Our site is currently undergoing scheduled maintenance. Please check back soon.
The server is temporarily unable to service your request. Try again later.
Connection to the database server failed.
An error occurred while loading this content.
This item is no longer available in your country.
503 Service Temporarily Unavailable
Fatal error: uncaught exception on line 112
JavaScript must be enabled in order to use this site.
This application requires JavaScript. Please turn it on and reload the page.
Your browser has JavaScript turned off. Please activate it to continue.
We have detected an ad blocker. Please disable it and reload.
Please wait while the page is loading... JavaScript is required.
Insert your product description here.
Description to follow shortly.
Add text here. Add text here.
This text is a placeholder and will be replaced.
Sample description. Replace before publication.
More information coming soon.
Ihre Sitzung ist leider abgelaufen. Bitte melden Sie sich neu an.
Diese Seite existiert nicht.
JavaScript ist in Ihrem Browser deaktiviert. Bitte aktivieren Sie JavaScript.
Hier folgt in Kürze die Beschreibung.
Cette page n'existe pas.
Une erreur interne du serveur est survenue.
JavaScript est désactivé dans votre navigateur.
Description bientôt disponible.
La página que busca no existe.
Ha ocurrido un error en el servidor.
Debe activar JavaScript en su navegador.
La descripción estará disponible próximamente.
Lorem ipsum dolor sit amet, sed do eiusmod tempor.
"""
REAL = """
The page about cleaning was missing from the manual, but the seller sent it within two days and the cup works well.
I asked the shop whether the dock needs a driver. It does not, and both screens came up at once.
The cable failed after a month. Support sent a new one without asking for anything.
Their website said my session expired twice while ordering, which cost me half an hour, but the mouse itself is good.
The app shows an error when the bulb is too far from the router. Moving it closer helped.
A short description of the fit: snug on a 13 inch laptop, loose on an 11 inch one.
Works as described, more than enough power for two phones.
I turned off the light and it did not turn on again until I reset the hub.
The text on the box is small and hard to read, the charger is fine.
Please check the length before you buy, mine was too short for the desk.
Die Lampe ist hell und leise, die Beschreibung stimmt.
El cable es largo y el color es bonito.
La tasse garde le café chaud pendant des heures.
My browser settings page opens slowly on this screen, otherwise a solid monitor.
I enabled the script mode of the keyboard and it types whole lines for me.
"""
FIELDS = ["Dear [Recipient], hi", "Hi :customer_name,", "That costs None USD.", "Thanks $first_name!", "Hello {{ customer.first_name }}", "Ship to ${shipping.address}", "Total: <%= order.total %>", "Dear <<Company>>", "Your %ORDER_NO% left", "From [[warehouse]] now", "{% include footer %}", "Pay @@sum_due@@ today", "On {delivery_date} it comes", "Hello *|FNAME|*", "Ref {!Case.Number}", "Only %(left)d left"]


def _lines(block):
    return block.strip().splitlines()


@pytest.fixture(scope="module")
def judged(spark, sf_dir):
    rows = [(-1 - k, t) for k, t in enumerate(_lines(RESIDUE) + _lines(REAL))]
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mine = spark.createDataFrame(rows, "doc_id long, text string")
    return {-1 - r.doc_id: r.label for r in find_residue(corpus.unionByName(mine)).filter(F.col("doc_id") < 0).collect()}


def test_other_wordings_are_found(judged):
    texts = _lines(RESIDUE)
    missed = [t for k, t in enumerate(texts) if judged[k] is None]
    assert len(missed) <= 0.1 * len(texts), missed


def test_real_texts_on_the_subject_stay(judged):
    first = len(_lines(RESIDUE))
    assert [t for k, t in enumerate(_lines(REAL)) if judged[first + k] is not None] == []


def test_other_syntaxes_are_found():
    missed = [t for t in FIELDS if not fields(t)]
    assert len(missed) <= 0.1 * len(FIELDS), missed
