"""Label tables: the classes of public data sets by number or by the name they have there, and the names that options bear.

Sources whose tables aren't here (long ones, or files of one's own) pass theirs as a table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Classes of the data sets in the order of their numbers, and intents of the banking and card domains, which evaluation sets have too.
CLINC = """
restaurant_reviews nutrition_info account_blocked oil_change_how time weather redeem_rewards interest_rate gas_type accept_reservations smart_home
user_name report_lost_card repeat whisper_mode what_are_your_hobbies order jump_start schedule_meeting meeting_schedule freeze_account what_song
meaning_of_life restaurant_reservation traffic make_call text bill_balance improve_credit_score change_language no measurement_conversion timer
flip_coin do_you_have_pets balance tell_joke last_maintenance exchange_rate uber car_rental credit_limit oos shopping_list expiration_date routing
meal_suggestion tire_change todo_list card_declined rewards_balance change_accent vaccines reminder_update food_last change_ai_name bill_due
who_do_you_work_for share_location international_visa calendar translate carry_on book_flight insurance_change todo_list_update timezone
cancel_reservation transactions credit_score report_fraud spending_history directions spelling insurance what_is_your_name reminder where_are_you_from
distance payday flight_status find_phone greeting alarm order_status confirm_reservation cook_time damaged_card reset_settings pin_change
replacement_card_duration new_card roll_dice income taxes date who_made_you pto_request tire_pressure how_old_are_you rollover_401k pto_request_status
how_busy application_status recipe calendar_update play_music yes direct_deposit credit_limit_change gas pay_bill ingredients_list lost_luggage
goodbye what_can_i_ask_you book_hotel are_you_a_bot next_song change_speed plug_type maybe w2 oil_change_when thank_you shopping_list_update
pto_balance order_checks travel_alert fun_fact sync_device schedule_maintenance apr transfer ingredient_substitution calories current_location
international_fees calculator definition next_holiday update_playlist mpg min_payment change_user_name restaurant_suggestion travel_notification
cancel pto_used travel_suggestion change_volume
""".split()
CLINC_EXCLUDED = """
account_blocked redeem_rewards interest_rate report_lost_card freeze_account bill_balance improve_credit_score balance exchange_rate credit_limit
expiration_date routing card_declined rewards_balance bill_due transactions credit_score report_fraud spending_history damaged_card pin_change
replacement_card_duration new_card application_status direct_deposit credit_limit_change pay_bill order_checks apr transfer international_fees
min_payment
""".split()
GO_EMOTIONS = """
admiration amusement anger annoyance approval caring confusion curiosity desire disappointment disapproval disgust embarrassment excitement fear
gratitude grief joy love nervousness optimism pride realization relief remorse sadness surprise neutral
""".split()
EMOTION = "sadness joy love anger fear surprise".split()
#: Classes and the names of their options, where these are more than the class in words.
YAHOO = """
Society & Culture = society and culture
Science & Mathematics = science and mathematics
Health = health
Education & Reference = education and reference
Computers & Internet = computers and internet
Sports = sports
Business & Finance = business and finance
Entertainment & Music = entertainment and music
Family & Relationships = family and relationships
Politics & Government = politics and government
"""
DBPEDIA = """
Company = company
EducationalInstitution = educational institution
Artist = artist
Athlete = athlete
OfficeHolder = office holder
MeanOfTransportation = means of transportation
Building = building
NaturalPlace = natural place
Village = village
Animal = animal
Plant = plant
Album = album
Film = film
WrittenWork = written work
"""
NEWSGROUPS = """
alt.atheism = atheism
comp.graphics = computer graphics
comp.os.ms-windows.misc = ms windows
comp.sys.ibm.pc.hardware = pc hardware
comp.sys.mac.hardware = mac hardware
comp.windows.x = x window system
misc.forsale = for sale
rec.autos = cars
rec.motorcycles = motorcycles
rec.sport.baseball = baseball
rec.sport.hockey = hockey
sci.crypt = cryptography
sci.electronics = electronics
sci.med = medicine
sci.space = space
soc.religion.christian = christianity
talk.politics.guns = gun politics
talk.politics.mideast = middle east politics
talk.politics.misc = general politics
talk.religion.misc = religion
"""
MASSIVE_SCENARIO = """
alarm = alarm
audio = audio
calendar = calendar
cooking = cooking
datetime = date and time
email = email
general = general
iot = smart home
lists = lists
music = music
news = news
play = play
qa = question answering
recommendation = recommendation
social = social media
takeaway = takeaway
transport = transport
weather = weather
"""
DAILYDIALOG = """
1 = inform
2 = question
3 = directive
4 = commissive
"""
TREC_COARSE = """
abbreviation = abbreviation
description and abstract concepts = description
entities = entity
human beings = person
locations = location
numeric values = number
"""

LABELS = "source string, raw string, place int, name string, excluded boolean"
#: Sources whose rows name their class by its number; the others by its text.
NUMBERED = {"clinc", "go_emotions", "emotion", "yahoo", "dbpedia"}


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" = ")) for line in text.strip().splitlines()]


def _tables() -> dict[str, list[tuple[str, str]]]:
    plain = {"clinc": CLINC, "go_emotions": GO_EMOTIONS, "emotion": EMOTION}
    paired = {"yahoo": YAHOO, "dbpedia": DBPEDIA, "newsgroups": NEWSGROUPS, "massive_scenario": MASSIVE_SCENARIO, "dailydialog": DAILYDIALOG, "trec": TREC_COARSE}
    return {k: [(x, x.replace("_", " ")) for x in v] for k, v in plain.items()} | {k: _pairs(v) for k, v in paired.items()}


def label_rows() -> list[tuple[str, str, int, str, bool]]:
    return [(source, raw, place, name, source == "clinc" and raw in CLINC_EXCLUDED) for source, rows in _tables().items() for place, (raw, name) in enumerate(rows)]


def label_table(spark: SparkSession) -> DataFrame:
    """source, raw, place, name, excluded: some 280 rows."""
    return spark.createDataFrame(label_rows(), LABELS)


def named(source: str, rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Mapped rows with their classes named by a label table, and rows of unknown or excluded classes marked.

    An unknown class is unlabelled. An excluded one is ``excluded_intent``, whatever else is amiss but the label. Sources without a table stay as they
    are. Several classes of one row (a comma between) are named one by one; one unknown makes the row unlabelled.
    """
    known = (label_table(rows.sparkSession) if labels is None else labels).where(F.col("source") == source)
    if labels is None and source not in _tables():
        return rows
    of = F.col("place").cast("string") if source in NUMBERED else F.col("raw")
    table = known.agg(F.map_from_entries(F.collect_list(F.struct(of, F.struct("name", "excluded")))).alias("_labels"))  # one row
    each = F.transform(F.split("cls", ","), lambda x: F.try_element_at(F.col("_labels"), x))
    found = rows.crossJoin(F.broadcast(table)).withColumn("_found", F.when(F.col("cls").isNotNull(), each))
    unknown = F.exists("_found", lambda x: x.isNull())
    excluded = F.exists("_found", lambda x: x["excluded"])
    late = F.coalesce(F.col("skip_reason"), F.lit("empty_text")).isin("empty_text", "too_short")
    reason = F.when(unknown & late, F.lit("unlabelled")).when(excluded & late, F.lit("excluded_intent")).otherwise(F.col("skip_reason"))
    names = F.when(unknown, F.lit(None).cast("string")).otherwise(F.array_join(F.transform("_found", lambda x: x["name"]), ","))
    return found.withColumns({"skip_reason": reason, "cls": names}).drop("_labels", "_found")
