"""A synthetic patient and four notes of our own wording, for trying the engine out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import write_pdf

DATE = "MM/dd/yyyy"

#: An invented patient.
PATIENT = {
    "first_name": "Tomas", "last_name": "Berger", "mrn": "40217736", "dob": "03/02/1961", "age": 63, "sex": "Male",
    "race": "Other", "ethnicity": "Unknown", "diagnosis": "Colon Adenocarcinoma", "diagnosis_date": "05/14/2024",
    "smoking_status": "Current", "pack_years": 12, "ecog_status": 2, "height_cm": 171, "weight_kg": 69, "bmi": 23.6,
    "diabetes": False, "hypertension": True, "comorbidities": ["Hypertension", "Gout"],
    "zipcode": "04109", "state": "Maine", "country": "United States", "residence_type": "Rural", "tumor_size_cm": 4.1,
}
# Days from diagnosis of each dated event.
EVENT_DAYS = {
    "exam_date": -12, "imaging_report_date": -11, "procedure_date": -7, "report_date": -4, "surgery_date": 21,
    "admission_date": 45, "discharge_date": 52, "followup_date1": 59, "followup_date2": 66, "followup_date3": 73,
}

_SUMMARY = """DISCHARGE SUMMARY
**Patient Name**: {first_name} {last_name}
**MRN**: {mrn}   **Born**: {dob}   **Written**: {current_date}

{first_name} {last_name} is a {age} year old {sex_lowercase} with {diagnosis}, found on {diagnosis_date}. {He_She} came in on {admission_date} and went home on {discharge_date}.
Other conditions: {comorbidities_list}. Smoking status: {smoking_status} ({pack_years} pack years, {smoking_quit_detail}). ECOG status: {ecog_status}. Height {height_cm} cm, weight {weight_kg} kg, BMI: {bmi}.
Lives in {state} {zipcode}, {country} ({residence_type}). Seen by Dr. Meyer, who asked {he_she} to return on {followup_date1}, {followup_date2} and {followup_date3}.
"""
_PATHOLOGY = """PATHOLOGY REPORT
Taken on {procedure_date}, reported on {report_date}. Patient: {last_name}, {first_name}.

Diagnosis: {diagnosis}. Tumor size: {tumor_size_cm} x {tumor_size_cm_width} x {tumor_size_cm_height} cm. EGFR mutation: Not Mutated. PD-L1 expression: 60.
"""
_SURGERY = """SURGICAL REPORT
Date: {surgery_date}. Patient: {last_name}, {first_name}, {race}, {ethnicity}.

A lobectomy was done for {cancer_type}. The mass measured {tumor_size_cm_adjusted} cm. Margins were clear! Did {he_she} do well? Yes. {He_She} left the theatre in good condition with {his_her} family informed.
"""
_IMAGING = """IMAGING REPORT
Examined on {exam_date}, reported on {report_date}.

CT of the chest shows a mass of {tumor_size_cm} cm in the right upper lobe. No other lesion was seen.
"""
NOTES = {"summary": _SUMMARY, "pathology": _PATHOLOGY, "surgery": _SURGERY, "imaging": _IMAGING}


def event_dates(diagnosis_date: Column, current: Column | None = None) -> dict[str, Column]:
    """The dated events around a diagnosis date, and the current date, all as MM/dd/yyyy text."""
    day = F.to_date(diagnosis_date, DATE)
    found = {name: F.date_format(F.date_add(day, n), DATE) for name, n in EVENT_DAYS.items()}
    return {"current_date": F.date_format(current if current is not None else F.current_date(), DATE)} | found


def patient(spark: SparkSession) -> DataFrame:
    """One row: the patient, the dates, and what else the notes say."""
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>"}
    row = spark.createDataFrame([tuple(PATIENT.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in PATIENT.items()))
    male, size = F.col("sex") == "Male", F.col("tumor_size_cm")
    pick = lambda a, b: F.when(male, a).otherwise(b)
    more = {
        "sex_lowercase": F.lower("sex"), "his_her": pick("his", "her"), "he_she": pick("he", "she"), "He_She": pick("He", "She"), "cancer_type": F.lit("lung cancer"), "comorbidities_list": F.array_join("comorbidities", ", "),
        "smoking_quit_detail": F.when(F.col("smoking_status") == "Former", "stopped for good in 2019").otherwise(""), "tumor_size_cm_width": F.round(size - 0.4, 1), "tumor_size_cm_height": F.round(size - 0.2, 1), "tumor_size_cm_adjusted": F.round(size + 0.3, 1),
    }
    # names that differ only by case stay apart: values go into a map for the templates
    slots = {k: F.col(k).cast("string") for k, v in PATIENT.items() if not isinstance(v, list)} | {k: v.cast("string") for k, v in (more | event_dates(F.col("diagnosis_date"))).items()}
    return row.select("*", F.create_map(*(x for k, v in slots.items() for x in (F.lit(k), v))).alias("slots"))


def fill_template(template: str, slots: Column, names: list[str]) -> Column:
    """The template with {name} replaced by each slot's value."""
    out = F.lit(template)
    for name in names:
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.try_element_at(slots, F.lit(name)), F.lit("")))
    return out


def synthetic_notes(spark: SparkSession) -> DataFrame:
    """patient_id, pdf_source and markdown_text of the four notes."""
    import re

    notes = F.array(*(F.struct(F.lit(f"{kind}.pdf").alias("pdf_source"), fill_template(t, F.col("slots"), sorted(set(re.findall(r"{(\w+)}", t)))).alias("markdown_text")) for kind, t in NOTES.items()))
    return patient(spark).select(F.col("mrn").alias("patient_id"), F.explode(notes).alias("n")).select("patient_id", "n.*")


def write_synthetic_notes(spark: SparkSession, folder: str, pdf: bool = True) -> str:
    """The four notes as files in folder: PDF, or Markdown in a folder for each kind."""
    for row in synthetic_notes(spark).collect():
        kind = row["pdf_source"].removesuffix(".pdf")
        if pdf:
            os.makedirs(folder, exist_ok=True)
            write_pdf(row["markdown_text"], os.path.join(folder, f"{kind}.pdf"))
        else:
            os.makedirs(os.path.join(folder, kind), exist_ok=True)
            with open(os.path.join(folder, kind, f"{kind}.md"), "w", encoding="utf-8") as file:
                file.write(row["markdown_text"])
    return folder
