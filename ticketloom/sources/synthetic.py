"""Deterministic multilingual tickets with gold labels.

Every choice is integer arithmetic on the row's own ids, so a ticket does not depend on partition
layout, retries or generation order, and any SQL engine can replay it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.session import computed_once

BILLING = "Billing & Payments"
ACCOUNT = "Account / KYC / Login"
TECHNICAL = "Technical / App crash"
ORDERS = "Product / Order / Delivery"
FRAUD = "Abuse / Safety / Fraud"
FEEDBACK = "Feedback / General"

# (department, urgency, language, text); {n} is a five-digit number, {amt} a rupee amount.
TEMPLATES: list[tuple[str, str, str, str]] = [
    (BILLING, "P1", "en", "My card was billed three times for order {n} and {amt} is gone from the salary account."),
    (BILLING, "P1", "en", "Subscription shows unpaid after I paid {amt}; the shop is closed to my customers until this is fixed."),
    (BILLING, "P2", "en", "Autopay took {amt} for a plan I ended in spring, mandate M{n}."),
    (BILLING, "P2", "en", "Refund for return {n} was promised last week and has not reached my bank."),
    (BILLING, "P3", "en", "Invoice {n} carries the wrong GST number, kindly reissue it."),
    (BILLING, "P3", "en", "Why did my monthly bill rise to {amt} without any notice?"),
    (BILLING, "P4", "en", "Where can I download old invoices, for example number {n}?"),
    (BILLING, "P1", "en", "The canteen till billed a whole school bus {amt} for tea, payment slip {n}, the driver is stranded."),
    (BILLING, "P1", "hi", "वेतन का पूरा भुगतान {amt} किसी और विक्रेता {n} को चला गया, आज ही रिफंड चाहिए।"),
    (BILLING, "P2", "hi", "किस्त की रकम {amt} से बढ़कर आई है, भुगतान का हिसाब भेजिए।"),
    (BILLING, "P3", "hi", "बिल {n} में गलत राशि लिखी है, कृपया सुधारें।"),
    (BILLING, "P4", "hi", "पुराने बिल की कॉपी कहाँ मिलेगी?"),
    (BILLING, "P1", "hinglish", "Cafe ka saara payment {amt} galat merchant {n} ko gaya, aaj salary deni hai."),
    (BILLING, "P2", "hinglish", "Coupon lagaya phir bhi bill poora {amt} ka bana, payment sheet {n} dekho."),
    (BILLING, "P2", "hinglish", "EMI ki kist {n} do mahine se zyada kat rahi hai, refund ka hisaab bhejo."),
    (BILLING, "P3", "hinglish", "Mera bill {amt} kaise aaya, plan toh chhota tha."),
    (ACCOUNT, "P1", "en", "Someone changed the password on my account {n} and I am locked out."),
    (ACCOUNT, "P1", "en", "KYC was rejected at midnight and withdrawals of {amt} are frozen for the whole team."),
    (ACCOUNT, "P2", "en", "After the number port my login OTP goes to the old SIM, ticket {n} is still open."),
    (ACCOUNT, "P2", "en", "PAN verification is stuck for two days, application {n}."),
    (ACCOUNT, "P3", "en", "Please change the email address linked with account {n}."),
    (ACCOUNT, "P4", "en", "How do I add a second user to the same login?"),
    (ACCOUNT, "P2", "hi", "नया सिम लेने पर लॉगिन का ओटीपी पुराने नंबर पर जाता है, आवेदन {n}।"),
    (ACCOUNT, "P3", "hi", "केवाईसी में नाम की वर्तनी बदलनी है।"),
    (ACCOUNT, "P4", "hi", "पासवर्ड बदलने का तरीका बताइए।"),
    (ACCOUNT, "P1", "hinglish", "Chacha ka account {n} do shehron se ek saath login dikha raha hai, password unke paas nahi raha."),
    (ACCOUNT, "P2", "hinglish", "Account {n} ka fingerprint login naye tablet par register nahi hota, kaise jodein."),
    (ACCOUNT, "P3", "hinglish", "KYC me PAN number galat dikha raha hai, kaise theek karo."),
    (TECHNICAL, "P1", "en", "Scanner screen freezes the app at all gates of hall {n}, visitors are queueing outside."),
    (TECHNICAL, "P2", "en", "The app on our weighing scale prints error {n} on every sack of rice since noon."),
    (TECHNICAL, "P3", "en", "Reports page loads slowly and shows error {n} now and then."),
    (TECHNICAL, "P4", "en", "Dark theme hides the save button on small screens."),
    (TECHNICAL, "P1", "hi", "मेले के द्वार {n} पर ऐप का स्कैनर जम गया है, क्रैश के बाद लोग बाहर खड़े हैं।"),
    (TECHNICAL, "P3", "hi", "ऐप में त्रुटि {n} बार बार दिखती है।"),
    (TECHNICAL, "P2", "hinglish", "Photo jodte hi app crash hota hai, gallery wala page khaali rehta hai."),
    (TECHNICAL, "P2", "hinglish", "Tractor wale tablet me app crash hota hai jab khet ka naksha {n} kholo."),
    (TECHNICAL, "P3", "hinglish", "Screen par error {n} dikha raha hai, kya karo samjhao."),
    (ORDERS, "P1", "en", "Insulin pack in order {n} was due yesterday and tracking shows nothing."),
    (ORDERS, "P2", "en", "Delivery {n} of saplings sits in the sun at the depot, please water them before transport."),
    (ORDERS, "P2", "en", "Tracking page https://track.example.in/p/{n} has not moved for five days."),
    (ORDERS, "P3", "en", "I received the wrong colour in order {n}, arrange an exchange."),
    (ORDERS, "P2", "hi", "ऑर्डर {n} अब तक नहीं पहुँचा, कब आएगा?"),
    (ORDERS, "P3", "hi", "सामान टूटा हुआ मिला, बदलकर दीजिए, ऑर्डर {n}।"),
    (ORDERS, "P2", "hinglish", "Mera order {n} abhi tak nahi aaya, saman kab milega?"),
    (ORDERS, "P3", "hinglish", "Saman galat aaya hai, order {n} exchange krdo."),
    (ORDERS, "P4", "hinglish", "Delivery ka time kaise badle, order {n} hai."),
    (FRAUD, "P1", "en", "A phishing SMS with your logo asks customers for the OTP, link https://secure-pay.example.com/{n} is live."),
    (FRAUD, "P1", "en", "Fake seller {n} took {amt} outside the app and vanished, this is fraud."),
    (FRAUD, "P1", "en", "The driver threatened me at my home after delivery {n}, I feel unsafe."),
    (FRAUD, "P2", "en", "I think profile {n} is a scam run by a bot, please look."),
    (FRAUD, "P1", "hi", "नकली किराये के विज्ञापन {n} से {amt} की ठगी हुई, यह धोखा है।"),
    (FRAUD, "P1", "hi", "मुझे धमकी भरे संदेश आ रहे हैं, आरोपी का नंबर {n} है।"),
    (FRAUD, "P1", "hinglish", "Fraud ho gaya bhai, fake link se {amt} nikal gaye hai."),
    (FRAUD, "P1", "hinglish", "Nakli kiraye ka fraud advert {n} chal raha hai, scam hai, log {amt} token de rahe hain."),
    (FEEDBACK, "P4", "en", "Thanks, agent {n} solved my problem with great patience."),
    (FEEDBACK, "P4", "en", "Suggestion: let the weather tile show tide times for fishing boats."),
    (FEEDBACK, "P3", "en", "The seed calendar mixes up monsoon months, a printed chart would help."),
    (FEEDBACK, "P4", "hi", "आपकी सेवा बहुत अच्छी है, धन्यवाद।"),
    (FEEDBACK, "P3", "hi", "सुझाव है कि मौसम की ची\u095bें बड़े अक्षरों में छापें, दादाजी पढ़ नहीं पाते।"),
    (FEEDBACK, "P4", "hinglish", "Mausam wala widget dekhkar bachche khush, accha laga."),
    (FEEDBACK, "P4", "hinglish", "Bahut accha support mila, dhanyavad bhai."),
]
AMOUNTS = ["Rs 52.50", "₹\u00a06,04,000", "INR 18"]
# Ways a ticket may go on, by language; an empty one leaves it as it is.
SUFFIXES: dict[str, list[str]] = {
    "en": ["", " It began on gate {n}.", " My neighbour saw it too.", "", " I write this from the train."],
    "hi": [" पड़ोसी ने भी देखा।", "", " यह द्वार {n} से शुरू हुआ।"],
    "hinglish": ["", " Padosi ne bhi dekha.", " Train se likh raha hoon, gate {n}."],
}
NOISE = ["...", "(2)", "~", "fwd:", "-- sent twice"]
GENERATED_CHANNELS = ["app", "email", "web", "whatsapp"]
NOISE_PERCENT = 8
NUMBER_BASE, NUMBER_RANGE = 10_000, 90_000


def template_bank(spark: SparkSession) -> DataFrame:
    """The template texts as a dimension table: one row per template, fixed size."""
    rows = [(i, *t) for i, t in enumerate(TEMPLATES)]
    return spark.createDataFrame(
        rows, "template_id bigint, department string, urgency string, language string, template string"
    )


def _pick(choices: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), index.cast("int"))


def render_tickets(ids: DataFrame, id_col: str, salt_col: str | None = None, seed: int = 0) -> DataFrame:
    """Add text, department, urgency, language and channel to every row of ``ids``.

    The only join is with the broadcast template bank, so generation never shuffles.
    """
    ident = F.col(id_col)
    salt = F.col(salt_col) if salt_col else F.lit(0)
    # Reduce first, then multiply: products stay far from the BIGINT limit for any id.
    small = F.pmod(ident, F.lit(999_983))
    choice = F.pmod(small * 31 + F.pmod(salt, F.lit(999_983)) * 17 + F.lit(seed), F.lit(len(TEMPLATES)))
    number = (F.pmod(F.pmod(ident, F.lit(NUMBER_RANGE)) * 7919, F.lit(NUMBER_RANGE)) + NUMBER_BASE).cast("string")
    suffix = F.lit("")
    for language, choices in SUFFIXES.items():
        suffix = F.when(
            F.col("language") == language,
            _pick(choices, F.pmod(F.floor(small / 7), F.lit(len(choices)))),
        ).otherwise(suffix)
    noise = F.when(
        F.pmod(small * 37 + 11, F.lit(100)) < NOISE_PERCENT,
        F.concat(F.lit(" "), _pick(NOISE, F.pmod(small, F.lit(len(NOISE))))),
    ).otherwise("")
    amount = _pick(AMOUNTS, F.pmod(F.floor(small / len(TEMPLATES)), F.lit(len(AMOUNTS))))
    body = F.replace(F.concat(F.col("template"), suffix), F.lit("{n}"), number)
    text = F.trim(F.concat(F.replace(body, F.lit("{amt}"), amount), noise))
    bank = F.broadcast(template_bank(ids.sparkSession))
    return (
        computed_once(ids.withColumn("template_id", choice).join(bank, "template_id"), text=text)
        .withColumn("channel", _pick(GENERATED_CHANNELS, F.pmod(F.floor(small / 3), F.lit(len(GENERATED_CHANNELS)))))
        .drop("template", "template_id")
    )


def generate(spark: SparkSession, n: int = 1200, seed: int = 42) -> DataFrame:
    """``n`` labelled tickets: id, text, department, urgency, language, channel, timestamp."""
    rows = render_tickets(spark.range(n), "id", seed=seed)
    day = F.pmod(F.col("id"), F.lit(28)).cast("int")
    start = F.lit("2026-09-01T10:00:00+05:30").cast("timestamp")
    number = (F.col("id") + 1).cast("string")
    return rows.select(
        F.concat(F.lit("T"), F.lpad(number, F.greatest(F.length(number), F.lit(4)), "0")).alias("id"),
        "text",
        "department",
        "urgency",
        "language",
        "channel",
        (start + F.make_dt_interval(days=day)).alias("timestamp"),
    )


def event_tickets(events: DataFrame) -> DataFrame:
    """The ticket table over an event stream: one ticket per event, created at the event time."""
    spine = events.select(
        F.col("event_id").alias("id"), F.col("user_id"), F.col("ts").alias("created_at")
    )
    return render_tickets(spine, "id", "user_id").select(
        "id", "created_at", "text", "department", "urgency", "language", "channel"
    )
