"""A policy corpus made from any table of documents, so that every rule has something to find.

Each document's text gets a few clauses, chosen by arithmetic on its id.  The
same clauses are available as columns and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hits, near misses, denials and lists, written for this corpus.  A line feed starts a new line.
CLAUSES = (
    # data collection, sensitive
    "Applicants enter a social security number on the tax form.", "We may verify your SSN with the bureau.", "The ssn of a device is not a person's number.", "A copy of your driver's licence is kept on file.", "A driver’s license may be shown at the desk.",
    "• Passport scans\n• Bank account details\n• Debit card numbers", "Medical history is recorded by the clinic.", "Health insurance numbers appear on the invoice.", "Protected classifications under state law.", "Race, ethnicity or religious belief, if you tell us.",
    "Biometric templates are created at the gate.", "Sensory data from the microphone.", "Faceprints help unlock the door.", "Precise geolocation is read while the app is open.", "Your position is estimated from nearby wi-fi signals.", "Bluetooth beacons give us tracking hints.",
    "Session-replay tools run on checkout pages.", "Keystrokes and mouse movements are logged.", "Screen recordings of support calls.", "Inferences drawn from what you buy.", "Partners create a profile about each visitor.", "We do not engage in profiling of minors.", "We never collect passport numbers.",
    "They don’t use biometric readers in stores.", "The race to the summit was long.",
    # data collection, ordinary
    "When you register we collect your full name and an email.", "Categories of personal information are listed below.", "Identifiers such as a cookie value.", "The information you provide stays yours.", "Your data will be collected at sign-up.", "The museum collects stamps and coins.", "We do not collect your address.",
    # data sale
    "We sell your personal data to the highest bidder.", "The sale of consumer information is part of our model.", "Your personal information may be sold to brokers.", "This may be considered a \"sale\" of records under the CCPA.", "Personal information was disclosed or sold last year.", "Records are sold and shared with resellers.",
    "We allow networks to collect page views in exchange for discounts.", "Vendors give us non-monetary consideration.", "Data is given in exchange for some other consideration.", "We have not sold your personal information.", "We may have sold the following categories of data.", "We do not sell your personal data.",
    "We won't ever sell your personal information.", "We never sell customer data.", "There is no sale of personal information here.", "Your user data is not sold.", "You have the right to stop the sale of your personal data.", "Consumers may direct us to stop selling personal information.", "Exercising the right to refuse the sale of your data is free.",
    "You can opt out of the sale of personal data.", "Do Not Sell My Personal Information", "You can request that we disclose what personal data we sold.", "We do not sell personal data in exchange for any consideration.",
    "We do not sell your data; however, we allow partners to collect user data in exchange for services.", "We do not transfer data in exchange for money, but we may provide your information to sponsors.", "We do not sell your data, but we will not share information either.", "We do not “sell” your personal data, although others sell user data.",
    "The company may sell or transfer part of its business with customer data.", "The bakery sells bread and rolls.", "We promise not to sell your personal data.", "Growth comes without selling personal information.",
    # third-party sharing
    "We share records with service providers.", "Audio data may be shared with Acme or Globex.", "Messages are shared with You and your family.", "We provide your account information to advertising agencies.", "Services provided by our affiliates are listed elsewhere.", "We disclose logs when served with a subpoena.",
    "We comply with lawful requests.", "We release files as required by applicable law.", "Our subsidiaries may share your personal data among themselves.", "Vendors receive your payment data.", "We may display your nickname to other forum members.", "You share photos with other users.",
    "In the event of a merger your account moves.", "After an acquisition your personal data is transferred.", "Records are processed outside the region.", "Servers are in countries other than yours.", "Your file is transferred to a centre in the United States.", "We do not share your personal data with third parties.",
    "We do not share your personal information except with your consent.", "We don't disclose user data unless a court order says so.", "We never share office space, except on Fridays.", "We never share your personal data unless a court tells us to.", "An advertiser pays for the banner.", "Ad partners pay for the space.", "We do not disclose payment data; but we share usage logs with analytics providers.", "We would not sell our chairs, however comfortable.", "We cannot share your data with third parties.",
    "We may share what you enter with:\n(1) our parent company\n(2) payment processors\n(a) nobody else", "We share your data with vendors such as:\n- hosting firms\n- Government entities\n\n- couriers", "Recipients:\n1. Advertising networks\n2. Data brokers.\n3. The weather", "Social media platforms", "Operating systems and platforms.",
    "We will not share it; nevertheless contractors may access your personal data.", "Protect your account against unauthorized disclosure.", "Document copies disclosed with Initech & Hooli are logged.",
    # retention
    "We keep records for as long as necessary.", "Data is stored for the duration of our relationship.", "Logs are retained for a reasonable period.", "Backups are kept indefinitely.", "We hold files until they are no longer needed.", "Drafts are held until no longer required.", "Invoices are preserved as required by law.", "We maintain copies for legal obligations.",
    "Data is retained for varying lengths of time.", "How long we keep it depends on the nature of the request.", "The criteria used to determine retention are internal.", "When storing it we consider the amount and sensitivity of the personal data.", "Several factors affect our retention schedule.", "Logs are deleted after twelve (12) months.",
    "We retain chats for 30 (thirty) days.", "Images are stored 90 days.", "Cookies are kept for one year.", "In the past 12 months nothing changed.", "The story took two weeks to tell.", "For as long as the sun shines.", "The library keeps its doors open.",
    # arbitration and class-action waiver
    "All claims go to binding arbitration.", "Disputes are resolved through individual arbitration.", "This arbitration agreement survives.", "Your agreement to arbitrate is final.", "You must submit any dispute to arbitration.", "You waive the right to a trial before a jury.", "An arbitrator may visit the gym.", "Waivers are signed at the pool.",
    "This class action waiver is severable.", "You waive taking part in any class proceeding.", "Class claims are hereby waived.", "You may sue, but not as a plaintiff or class member.", "No class actions are allowed.", "Disputes must be brought on an individual basis.", "Every request is looked at on an individual basis.",
    "On an individual basis only, no collective claims.", "A class or collective action is barred.", "The yoga class starts at nine.",
    # segmentation
    "Contact Acme Inc. Today we write to Dr. Lee, e.g. about U.S. law no. 5.", "Version 2.5 costs 3.50 today?! \"Really.\" Yes (it does.) ok... fine.", "See Section A. Next comes B. and so on etc. and more.", "Nous vendons é. Personne ne sell your personal data ici.", "😀 We sell your personal data 😀. Ok.",
    "Annex A" + "." * 80 + " 12 and more. See no" + "." * 70 + " Next", "We sell your personal data: " + "😀" * 70 + " to all", "The period was long " + "😀" * 70 + " indeed",
    "Terms:\n\n  •\tFirst one. Second one.\n1) third\nClosing line.\n- not carried", "We collect:\n  2. your email\n  3. your phone",
)
#: Committed excerpts (name, text), and what must and must not be found in them (name, category, must, part of a sentence).
EXCERPTS = (
    ("shop", "Your order and you.\nWhen you register we collect your full name and an email. We may verify your SSN with the bureau. The race to the summit was long. We never collect passport numbers.\n"
             "Protected classifications under state law. Inferences drawn from what you buy. Faceprints help unlock the door. The museum collects stamps and coins. Session-replay tools run on checkout pages.\n"
             "Categories of personal information are listed below. Identifiers such as a cookie value."),
    ("market", "We sell your personal data to the highest bidder. We do not sell your address book. The bakery sells bread and rolls.\nPersonal information was disclosed or sold last year. Vendors give us non-monetary consideration.\n"
               "You can opt out of the sale of personal data. Consumers may direct us to stop selling personal information. There is no sale of personal information here.\n"
               "We do not “sell” your personal data, although others sell user data. We may have sold the following categories of data."),
    ("forum", "We share records with service providers. We never share office space, except on Fridays. We may share what you enter with:\n(1) our parent company\n(2) payment processors\n(a) nobody else\n"
              "We disclose logs when served with a subpoena. We do not share your personal data with third parties. Audio data may be shared with Acme or Globex. You share photos with other users.\n"
              "In the event of a merger your account moves. Records are processed outside the region. An advertiser pays for the banner. We do not share your personal information except with your consent."),
    ("archive", "We keep records for as long as necessary. Data is stored for the duration of our relationship. Backups are kept indefinitely. The library keeps its doors open.\n"
                "Logs are deleted after twelve (12) months. Cookies are kept for one year. In the past 12 months nothing changed. Several factors affect our retention schedule.\n"
                "The criteria used to determine retention are internal. The story took two weeks to tell. Data is retained for varying lengths of time."),
    ("court", "All claims go to binding arbitration. Disputes are resolved through individual arbitration. Your agreement to arbitrate is final. An arbitrator may visit the gym.\n"
              "You waive the right to a trial before a jury. Class claims are hereby waived. You may sue, but not as a plaintiff or class member. No class actions are allowed. The yoga class starts at nine.\n"
              "Disputes must be brought on an individual basis. Waivers are signed at the pool. A class or collective action is barred."),
)
_COLLECTS, _SALE, _SHARES, _KEEPS, _ARBITRATION, _CLASS = "data_collection", "data_sale", "third_party_sharing", "retention", "arbitration", "class_action_waiver"
PINS = tuple(
    (name, category, must, needle)
    for name, category, must, needles in (
        ("shop", _COLLECTS, True, ("full name", "SSN", "Protected classifications", "Inferences drawn", "Faceprints", "Session-replay", "Categories of personal", "Identifiers such as")),
        ("shop", _COLLECTS, False, ("passport numbers", "stamps and coins", "order and you")),
        ("shop", _SALE, False, ("full name", "buy")),
        ("market", _SALE, True, ("highest bidder", "disclosed or sold", "non-monetary", "although others", "following categories")),
        ("market", _SALE, False, ("address book", "bread", "opt out", "stop selling", "no sale of")),
        ("forum", _SHARES, True, ("service providers", "parent company", "payment processors", "subpoena", "Acme or Globex", "merger", "outside the region", "except with your consent")),
        ("forum", _SHARES, False, ("office space", "nobody else", "with third parties", "photos", "banner")),
        ("archive", _KEEPS, True, ("as long as necessary", "duration of our relationship", "indefinitely", "twelve (12) months", "one year", "Several factors", "criteria used", "varying lengths")),
        ("archive", _KEEPS, False, ("doors open", "nothing changed")),
        ("court", _ARBITRATION, True, ("binding arbitration", "individual arbitration", "agreement to arbitrate", "trial before a jury")),
        ("court", _ARBITRATION, False, ("visit the gym", "signed at the pool")),
        ("court", _CLASS, True, ("hereby waived", "plaintiff or class member", "No class actions", "brought on an individual basis", "collective action")),
        ("court", _CLASS, False, ("yoga class", "trial before a jury", "signed at the pool")),
    )
    for needle in needles
)
#: Clauses added to a document, and the steps through the list by id and by clause.
EACH, BY_ID, BY_PLACE = 6, 7, 37


def policy_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): every text followed by some clauses, one below the other."""
    clauses = F.array(*map(F.lit, CLAUSES))
    chosen = [F.element_at(clauses, (F.pmod(F.coalesce(F.col(key), F.lit(0)) * BY_ID + j * BY_PLACE, F.lit(len(CLAUSES))) + 1).cast("int")) for j in range(EACH)]
    return docs.select(key, F.concat_ws("\n", F.coalesce(F.col(text), F.lit("")), *chosen).alias("text"))


def policy_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """SELECT (key, text) of the same corpus."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = "[" + ", ".join(q(c) for c in CLAUSES) + "]"
    picks = ", ".join(f"c[((coalesce({key}, 0) * {BY_ID} + {j * BY_PLACE}) % {len(CLAUSES)}) + 1]" for j in range(EACH))
    return f"SELECT {key}, concat_ws(chr(10), coalesce({text}, ''), {picks}) AS text FROM {table}, (SELECT {values} AS c)"
