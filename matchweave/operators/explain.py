"""Texts that explain a ranked result: a signal breakdown and a narrative.

Both are Column expressions meant for the final top results.  Rows carry the normalised
signals, ``wanted``, ``modalities``, ``matched_modalities``, ``concerns`` and profile fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.text import strip, title

# ---------------------------------------------------------------- fixed values
MODALITY_NAMES = {
    "cognitive_behavioral_therapy": "Cognitive Behavioral Therapy (CBT)",
    "dialectical_behavior_therapy": "Dialectical Behavior Therapy (DBT)",
    "emdr": "EMDR",
    "acceptance_commitment_therapy": "Acceptance and Commitment Therapy (ACT)",
    "psychodynamic": "psychodynamic therapy",
    "humanistic": "humanistic therapy",
    "mindfulness_based": "mindfulness-based therapy",
    "somatic": "somatic therapy",
    "gottman_method": "Gottman Method",
    "emotionally_focused_therapy": "Emotionally Focused Therapy (EFT)",
    "exposure_therapy": "exposure therapy",
    "cognitive_processing_therapy": "Cognitive Processing Therapy (CPT)",
    "narrative_therapy": "narrative therapy",
    "solution_focused": "solution-focused therapy (SFBT)",
    "motivational_interviewing": "motivational interviewing",
    "play_therapy": "play therapy",
    "art_therapy": "art therapy",
    "psychoanalytic": "psychoanalytic therapy",
    "integrative": "integrative therapy",
    "cbt_insomnia": "CBT for Insomnia (CBT-I)",
    "trauma_informed": "trauma-informed therapy",
    "family_systems": "family systems therapy",
}

MODALITY_DESCRIPTIONS = {
    "cognitive_behavioral_therapy": "Identifying and restructuring negative thought patterns and cognitive distortions to change behaviour and improve emotional regulation.",
    "dialectical_behavior_therapy": "Teaching distress tolerance, emotion regulation, mindfulness, and interpersonal effectiveness skills to people with intense emotional responses.",
    "emdr": "Processing traumatic memories through bilateral stimulation such as eye movements to reduce their emotional charge and distress.",
    "acceptance_commitment_therapy": "Developing psychological flexibility by accepting difficult thoughts and feelings and committing to values-based action.",
    "psychodynamic": "Exploring unconscious patterns, early experiences, and relational dynamics to understand how the past shapes current emotions and behaviour.",
    "humanistic": "Supporting personal growth and self-actualisation through empathy, unconditional positive regard, and the therapeutic relationship.",
    "mindfulness_based": "Using present-moment awareness and non-judgmental attention to reduce stress, anxiety, and depressive relapse.",
    "somatic": "Working with bodily sensations, posture, and movement to release trauma and stress stored in the body.",
    "gottman_method": "Evidence-based couples therapy focused on building friendship, managing conflict, and creating shared meaning in relationships.",
    "emotionally_focused_therapy": "Restructuring emotional responses and attachment bonds in couples and individuals to build secure, loving relationships.",
    "exposure_therapy": "Gradually and systematically confronting feared situations or memories to reduce avoidance and anxiety responses.",
    "cognitive_processing_therapy": "Helping trauma survivors identify and challenge unhelpful beliefs about safety, trust, power, esteem, and intimacy formed after traumatic events.",
    "narrative_therapy": "Externalising problems and re-authoring personal stories to help clients build preferred identities separate from their difficulties.",
    "solution_focused": "Focusing on strengths, resources, and future goals rather than analysing problems and past causes.",
    "motivational_interviewing": "Evoking intrinsic motivation to change by exploring ambivalence and strengthening commitment to behavioural goals.",
    "play_therapy": "Using play as a natural medium for children to express feelings, process experiences, and develop coping skills.",
    "art_therapy": "Using creative art-making to express emotions, process trauma, and promote self-awareness and healing.",
    "psychoanalytic": "Deep exploration of unconscious conflicts, drives, and early developmental experiences through free association and dream analysis.",
    "integrative": "Drawing flexibly from multiple therapeutic traditions to tailor treatment to each individual client's needs.",
    "cbt_insomnia": "Addressing the thoughts and behaviours that perpetuate chronic insomnia through sleep restriction, stimulus control, and cognitive restructuring.",
    "trauma_informed": "Recognising the pervasive impact of trauma and prioritising physical, psychological, and emotional safety in all aspects of care.",
    "family_systems": "Understanding individuals within the context of their family relationships and working to change dysfunctional interaction patterns.",
}

WHY_SENTENCES = {
    "anxiety": {
        "cognitive_behavioral_therapy": "CBT is one of the most well-researched treatments for anxiety, helping to identify and reframe the thought patterns that fuel worry.",
        "acceptance_commitment_therapy": "ACT helps with anxiety by building tolerance for uncertainty and redirecting focus toward what matters most.",
        "exposure_therapy": "Exposure therapy directly addresses anxiety by gradually reducing avoidance, which is what keeps anxiety going.",
        "mindfulness_based": "Mindfulness-based approaches help break the cycle of anxious rumination by building present-moment awareness.",
        "dialectical_behavior_therapy": "DBT provides concrete skills for managing overwhelming anxiety, including distress tolerance and emotion regulation.",
    },
    "depression": {
        "cognitive_behavioral_therapy": "CBT for depression targets the negative thought patterns and behavioural withdrawal that maintain low mood.",
        "psychodynamic": "Psychodynamic therapy can uncover the deeper roots of depression, including unresolved grief, relational patterns, and self-critical beliefs.",
        "acceptance_commitment_therapy": "ACT helps with depression by loosening the grip of self-critical thoughts and reconnecting with personal values.",
        "mindfulness_based": "Mindfulness-based approaches are particularly effective for preventing depressive relapse by changing the relationship with difficult thoughts.",
        "humanistic": "Humanistic therapy addresses depression by rebuilding self-worth and reconnecting with a sense of purpose.",
    },
    "trauma": {
        "emdr": "EMDR is specifically designed for trauma — it helps the brain process distressing memories so they lose their emotional charge.",
        "cognitive_processing_therapy": "CPT directly addresses the unhelpful beliefs about safety, trust, and self-blame that often follow traumatic experiences.",
        "somatic": "Somatic therapy is particularly valuable for trauma held in the body — physical tension, hypervigilance, and dissociation.",
        "trauma_informed": "A trauma-informed approach ensures that all aspects of therapy prioritise safety and avoid re-traumatisation.",
        "psychodynamic": "Psychodynamic therapy can help explore how past trauma shapes current relationships and emotional responses.",
    },
    "grief": {
        "humanistic": "Humanistic therapy creates a safe, non-judgmental space to sit with grief at your own pace.",
        "psychodynamic": "Psychodynamic work can help process complicated grief, especially when loss connects to earlier experiences.",
        "acceptance_commitment_therapy": "ACT helps with grief by making room for painful feelings rather than fighting them, while staying connected to what still matters.",
        "narrative_therapy": "Narrative therapy helps people honour what was lost and find ways to carry that story forward.",
    },
    "stress": {
        "mindfulness_based": "Mindfulness-based approaches directly target the physiological and cognitive patterns of chronic stress.",
        "acceptance_commitment_therapy": "ACT helps reduce stress-driven burnout by clarifying values and addressing overcommitment patterns.",
        "cognitive_behavioral_therapy": "CBT addresses the perfectionism and all-or-nothing thinking that often drives chronic stress.",
        "somatic": "Somatic work helps discharge the physical toll of prolonged stress held in the nervous system.",
    },
}

CHECKED_WANTED = 0.3


# ---------------------------------------------------------------- shared pieces
def _fixed(col: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", col.cast("double"))


def _given(col: Column) -> Column:
    return F.coalesce(col, F.lit("")) != ""


def _wanted_names() -> Column:
    strong = F.filter(F.col("wanted"), lambda e: e["weight"] > CHECKED_WANTED)
    return F.array_sort(F.coalesce(
        F.transform(strong, lambda e: e["modality"]), F.array().cast("array<string>")))


def _number(value: float) -> str:
    return repr(float(value))


# ---------------------------------------------------------------- signal breakdown
def debug_explanation() -> Column:
    """``[SCORES] ... || [MODALITY] ... || ...`` with fixed thresholds."""
    city = _given(F.col("preferred_city"))

    def scores(weights: dict[str, float]) -> Column:
        parts = [("modality", "modality_score"), ("semantic", "semantic_score"),
                 ("bm25", "bm25_score"), ("quality", "quality_score")]
        total = F.coalesce("location_score", F.lit(0.0)) * weights["location"]
        for name, column in reversed(parts):
            total = F.col(column) * weights[name] + total
        pieces = [F.concat(F.lit(f"{n}="), _fixed(F.col(c), 3), F.lit(f"×{_number(weights[n])}"))
                  for n, c in parts]
        return F.concat_ws(" | ", F.concat(F.lit("[SCORES] composite="), _fixed(total, 3)), *pieces)

    offered = F.array_sort(F.array_distinct("modalities"))
    wanted = _wanted_names()
    hit, miss = F.array_intersect(wanted, offered), F.array_except(wanted, offered)

    def listing(items: Column, empty: str) -> Column:
        return F.when(F.size(items) == 0, F.lit(empty)).otherwise(F.array_join(items, ", "))

    has = F.concat(F.lit("therapist has: "), listing(offered, "none listed"))
    modality = F.when(F.size(hit) > 0, F.concat_ws(
        " | ", F.concat(F.lit("[MODALITY] matched="), listing(hit, "none")),
        F.concat(F.lit("missed="), listing(miss, "none")), has)).otherwise(F.concat_ws(
            " | ", F.concat(F.lit("[MODALITY] no modality overlap — query wants: "),
                            listing(wanted, "none")), has))

    def signal(tag: str, column: str, high: float, mid: float, texts: tuple[str, str, str]) -> Column:
        text = (F.when(F.col(column) >= high, texts[0]).when(F.col(column) >= mid, texts[1])
                .otherwise(texts[2]))
        return F.concat(F.lit(f"[{tag}] "), text, F.lit(" (normalized="), _fixed(F.col(column), 3),
                        F.lit(")"))

    semantic = signal("SEMANTIC", "semantic_score", 0.7, 0.4, (
        "high — profile language closely mirrors query",
        "moderate — partial thematic overlap with query",
        "low — profile embedding diverges from query vector"))
    bm25 = signal("BM25", "bm25_score", 0.6, 0.3, (
        "high — strong exact-term overlap", "moderate — some shared vocabulary",
        "low — few query terms appear in bio"))
    rated = F.coalesce(F.col("rating").cast("double"), F.lit(0.0)) != 0
    stars = F.when(rated, F.concat(_fixed(F.col("rating"), 1), F.lit("★ ("),
                                   F.col("review_count").cast("string"), F.lit(" reviews)"))
                   ).otherwise("no rating")
    quality = F.concat_ws(
        " | ", F.concat(F.lit("[QUALITY] "), stars),
        F.concat(F.lit("completeness="), _fixed(F.col("profile_completeness"), 2)),
        F.concat(F.lit("normalized="), _fixed(F.col("quality_score"), 3)))
    boost = _number(vocab.WEIGHTS_WITH_CITY["location"])
    place = F.when(city, F.concat_ws(
        " | ", F.concat(F.lit("[LOCATION] preferred="), F.col("preferred_city")),
        F.concat(F.lit("therapist="), F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("unknown"))),
        F.concat(F.when(F.col("location_score") == 1.0, "matched").otherwise("no match"),
                 F.lit(f" (boost={boost}×"), _fixed(F.coalesce("location_score", F.lit(0.0)), 0),
                 F.lit(")"))))
    first = F.when(city, scores(vocab.WEIGHTS_WITH_CITY)).otherwise(scores(vocab.WEIGHTS))
    return F.concat_ws(" || ", first, modality, semantic, bm25, quality, place)


# ---------------------------------------------------------------- narrative
def modality_name(modality: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in MODALITY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, modality),
                      title(F.replace(modality, F.lit("_"), F.lit(" "))))


def _first_names(modalities: Column, n: int) -> Column:
    return F.transform(F.slice(modalities, 1, n), modality_name)


def why_sentence(concerns: Column, modality: Column) -> Column:
    """Why a modality helps with the first concern that has a sentence for it."""
    flat = {f"{c}|{m}": s for c, ms in WHY_SENTENCES.items() for m, s in ms.items()}
    table = F.create_map(*[F.lit(x) for kv in flat.items() for x in kv])
    found = F.transform(
        concerns, lambda c: F.try_element_at(table, F.concat(F.lower(c), F.lit("|"), modality)))
    return F.get(F.array_compact(found), F.lit(0))


def _bio_opening() -> Column:
    first = strip(F.get(F.split(F.coalesce("bio", F.lit("")), r"\."), F.lit(0)))
    fits = (F.length(first) > 20) & (F.length(first) < 180)
    return F.when(fits & (F.col("semantic_score") >= 0.5), F.concat(first, F.lit(".")))


def _practice() -> Column:
    concerns = F.coalesce("concerns", F.array().cast("array<string>"))
    phrase = F.array_join(F.slice(concerns, 1, 3), " and ")
    matched = F.col("matched_modalities")
    named = _first_names(matched, 3)
    joined = F.when(F.size(named) > 1, F.concat(
        F.array_join(F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0))), ", "), F.lit(" and "),
        F.try_element_at(named, F.lit(-1)))).otherwise(F.try_element_at(named, F.lit(1)))
    suited = F.when(phrase != "", F.concat(
        F.lit("They practise "), joined, F.lit(" — approaches well suited to "), phrase, F.lit("."))
    ).otherwise(F.concat(F.lit("They practise "), joined,
                         F.lit(", which aligns closely with what you described.")))
    missed = F.array_except(_wanted_names(), F.col("modalities"))
    gap = F.when((F.size(missed) > 0) & (F.col("modality_score") < 0.8), F.concat(
        F.lit("They don't list "), F.array_join(_first_names(missed, 2), " or "),
        F.lit(", which was also flagged for your concerns — worth asking about in a consultation.")))
    strong = F.concat_ws(" ", suited, why_sentence(concerns, F.get(matched, F.lit(0))), gap)
    some = F.concat(F.lit("They have some experience with "),
                    F.array_join(_first_names(matched, 2), " and "),
                    F.lit(", though their coverage of recommended approaches is partial."))
    wanted = _first_names(_wanted_names(), 3)
    none = F.when(F.size(wanted) > 0, F.concat(
        F.lit("Their profile doesn't list the specific approaches most recommended for your concerns ("),
        F.array_join(wanted, ", "), F.lit("), but their overall profile language is a strong fit."))
    ).otherwise("Ranked based on how closely their overall profile matches what you described.")
    return (F.when((F.size(matched) > 0) & (F.col("modality_score") >= 0.5), strong)
            .when(F.size(matched) > 0, some).otherwise(none))


def _relevance() -> Column:
    high, words = F.col("semantic_score") >= 0.6, F.col("bm25_score") >= 0.5
    low = (F.col("semantic_score") < 0.35) & (F.col("bm25_score") < 0.3)
    return (F.when(high & words,
                   "Reading their bio, the themes and language closely reflect what you shared — "
                   "the way they describe their work suggests a genuine fit.")
            .when(high, "Their therapeutic style and the way they describe their work aligns well with "
                  "what you're going through, even if they use somewhat different language.")
            .when(words, "Their bio touches on several of the themes you mentioned directly.")
            .when(low, "This match is driven more by their clinical specialisation than by direct "
                  "language overlap with your description — reading their full profile is "
                  "especially worthwhile here."))


def _place() -> Column:
    want = F.col("preferred_city")
    here = F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("another city"))
    online = F.coalesce(F.arrays_overlap(
        F.col("session_formats"), F.array(F.lit("telehealth"), F.lit("both"))), F.lit(False))
    return F.when(_given(want), F.when(F.col("location_score") == 1.0, F.concat(
        F.lit("They are based in "), want, F.lit(", matching your location.")))
        .when(online, F.concat(F.lit("They are based in "), here, F.lit(" rather than "), want,
                               F.lit(", but offer online sessions so distance isn't a barrier.")))
        .otherwise(F.concat(F.lit("They are based in "), here, F.lit(", not "), want, F.lit(
            " — confirm whether they see clients in your area before booking."))))


def _credibility() -> Column:
    star = F.round(F.col("rating").cast("double"), 1)
    n = F.col("review_count").cast("string")
    known = (F.coalesce(star, F.lit(0.0)) != 0) & (F.col("review_count") >= 5)
    return F.when(known & (star >= 4.5), F.concat(
        F.lit("They are highly rated at "), _fixed(star, 1), F.lit("★ across "), n,
        F.lit(" client reviews."))).when(known & (star >= 4.0), F.concat(
            F.lit("Rated "), _fixed(star, 1), F.lit("★ from "), n, F.lit(" reviews.")))


def narrative() -> Column:
    """Opening, specialisation, relevance, location and credibility sentences."""
    return F.concat_ws(" ", _bio_opening(), _practice(), _relevance(), _place(), _credibility())
