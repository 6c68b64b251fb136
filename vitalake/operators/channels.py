"""Canonical paths with their source names, and the mapping tables of the channels (M1, M3)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vitalake.functions import text as T, trees
from vitalake.operators import sections as S

# Other names of each canonical path, in order. The path's own last part is always the first name.
OTHER_NAMES = {
    "candidate.fullName": "full_name name candidate_name candidateName",
    "candidate.firstName": "first_name fname",
    "candidate.middleName": "middle_name mname",
    "candidate.lastName": "last_name lname surname",
    "candidate.phoneNumber": "phone_number phone mobile mobileNumber contact",
    "candidate.alternatePhoneNumber": "alternate_phone alternatePhone secondaryPhone",
    "candidate.email": "emailAddress email_address mail",
    "candidate.portalId": "portal_id employeeId employee_id empId id",
    "candidate.dateOfBirth": "date_of_birth dob birthDate",
    "candidate.gender": "sex",
    "candidate.nationality": "nation citizenship",
    "candidate.currentLocation.city": "currentCity location_city locationCity",
    "candidate.currentLocation.state": "currentState location_state province",
    "candidate.currentLocation.country": "currentCountry location_country",
    "candidate.currentLocation.fullAddress": "address full_address completeAddress",
    "candidate.preferredLocation": "preferred_location preferredLocations targetLocations",
    "candidate.totalExperienceYears": "total_experience_years experienceYears yearsOfExperience",
    "candidate.totalExperienceMonths": "total_experience_months experienceMonths",
    "candidate.relevantExperienceYears": "relevant_experience_years relevantYears",
    "candidate.relevantExperienceMonths": "relevant_experience_months relevantMonths",
    "candidate.currentOrganization": "current_organization currentCompany organization company",
    "candidate.currentDesignation": "current_designation designation jobTitle title role",
    "candidate.currentCTC": "current_ctc currentSalary salary ctc",
    "candidate.expectedCTC": "expected_ctc expectedSalary expectedCompensation",
    "candidate.noticePeriod": "notice_period noticePeriodDays availability",
    "candidate.employmentType": "employment_type jobType contractType",
    "candidate.summary": "professionalSummary professional_summary profile about",
    "candidate.careerObjective": "career_objective objective goals",
    "skills.primarySkills": "primary_skills coreSkills mainSkills",
    "skills.secondarySkills": "secondary_skills additionalSkills",
    "skills.technicalSkills": "technical_skills techSkills skills",
    "skills.functionalSkills": "functional_skills domainSkills",
    "skills.softSkills": "soft_skills interpersonalSkills",
    "skills.toolsAndPlatforms": "tools_and_platforms tools platforms",
    "skills.operatingSystems": "operating_systems os operatingSystemsUsed",
    "skills.databases": "database db databaseTechnologies",
    "skills.cloudTechnologies": "cloud_technologies cloud cloudPlatforms",
    "skills.frameworks": "framework",
    "skills.libraries": "library libs",
    "skills.aiToolsAndFrameworks": "ai_tools mlTools aiFrameworks",
    "experience.totalProjects": "total_projects projectCount",
    "experience.domainExperience": "domain_experience domains expertise",
    "experience.industriesWorked": "industries_worked industries sectors",
    "experience.workHistory": "work_history employmentHistory jobs employment",
    "experience.projects": "projectDetails project_details projectHistory",
}
#: A path that counts something is 0 where no name has a value.
_COUNTS = re.compile(r"(Years|Months|totalProjects)$")
#: canonical path -> (source names in order, default)
REGISTRY: dict[str, tuple[list[str], str | None]] = {
    path: ([path.rsplit(".", 1)[1], *names.split()], "0" if _COUNTS.search(path) else None) for path, names in OTHER_NAMES.items()
}

# Targets that every channel must fill.
MANDATORY = [f"candidate.{x}" for x in ("fullName", "phoneNumber", "email", "currentLocation", "currentOrganization", "currentDesignation")]
# Names in transcripts that are not the target's last part in snake case, in order.
AUDIO_NAMES = {
    "candidate.alternatePhoneNumber": ["alternate_phone"],
    "candidate.portalId": ["portal_id", "employee_id"],
    "candidate.currentLocation": ["current_location", "location"],
    "candidate.preferredLocation": ["preferred_locations"],
    "candidate.totalExperienceYears": ["total_experience"],
    "candidate.relevantExperienceYears": ["relevant_experience"],
    "candidate.currentOrganization": ["current_organization", "current_company"],
    "candidate.currentDesignation": ["current_designation", "current_role"],
    "candidate.summary": ["professional_summary", "summary"],
    "skills.aiToolsAndFrameworks": ["ai_tools"],
}
# Targets of transcripts outside the registry.
AUDIO_MORE = ["candidate.currentLocation", "education", "certifications", "achievements"] + [
    f"personalDetails.{x}" for x in ("languagesKnown", "maritalStatus", "passportNumber", "linkedinUrl", "githubUrl", "portfolioUrl")]
# Names in conversations, in order.
BOT_NAMES = {
    "candidate.fullName": ["candidateName", "name"],
    "candidate.phoneNumber": ["contactNumber", "phone"],
    "candidate.email": ["emailAddress", "email"],
    "candidate.portalId": ["employeeId", "portalId"],
    "candidate.currentLocation": ["currentLocation"],
    "candidate.totalExperienceYears": ["totalExperience"],
    "candidate.currentOrganization": ["organization", "currentOrganization"],
    "candidate.currentDesignation": ["designation", "currentDesignation"],
    "skills.primarySkills": ["skills", "primarySkills"],
    "skills.secondarySkills": ["secondarySkills"],
    "skills.technicalSkills": ["technicalSkills"],
    "experience.workHistory": ["workExperience"],
    "experience.projects": ["projectDetails", "projects"],
    "education": ["education", "educationDetails"],
    "certifications": ["certifications"],
}
# Names in documents, in order.
DOCUMENT_NAMES = {
    "candidate.fullName": ["Name", "Full Name"],
    "candidate.phoneNumber": ["Phone", "Mobile"],
    "candidate.email": ["Email"],
    "candidate.portalId": ["Employee ID", "Portal ID"],
    "candidate.currentLocation": ["Location", "Current Location"],
    "candidate.totalExperienceYears": ["Total Experience", "Experience"],
    "candidate.currentOrganization": ["Current Organization", "Organization", "Company"],
    "candidate.currentDesignation": ["Current Designation", "Designation", "Role"],
    "skills.primarySkills": ["Skills", "Primary Skills"],
    "skills.secondarySkills": ["Secondary Skills"],
    "skills.technicalSkills": ["Technical Skills"],
    "experience.workHistory": ["Work History", "Employment History"],
    "experience.projects": ["Projects", "Project Details"],
    "education": ["Education", "Educational Qualifications"],
    "certifications": ["Certifications"],
}


def _snake(path: str) -> str:
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", path.rsplit(".", 1)[-1]).lower()


_AUDIO_TARGETS = [p for p in REGISTRY if not p.startswith("candidate.currentLocation.") and p != "experience.totalProjects"] + AUDIO_MORE
CHANNELS: dict[str, dict[str, list[str]]] = {
    "audio_upload": {p: AUDIO_NAMES.get(p, [_snake(p)]) for p in _AUDIO_TARGETS},
    "bot_conversation": BOT_NAMES,
    "document_upload": DOCUMENT_NAMES,
}
#: Other names of a channel's table.
SAME_TABLE = {"start_recording": "audio_upload", "docx_upload": "document_upload", "pdf_upload": "document_upload"}


def split_list(value: Column) -> Column:
    """Texts of a comma list, of a list's filled items, or of all members of an object, trimmed, none blank."""
    def cut(x: Column) -> Column:
        return F.filter(F.transform(F.split(x, ","), lambda t: F.trim(t)), lambda t: t != "")

    def member(e: Column) -> Column:
        return F.when(trees.items(e["value"]).isNotNull(), F.transform(S._list(e["value"]), S.printed)).when(
            S._is_text(e["value"]), F.split(S.printed(e["value"]), ",")).otherwise(F.array().cast("array<string>"))

    members = F.flatten(F.transform(F.map_entries(trees.members(value)), member))
    return F.when(trees.members(value).isNotNull(), F.filter(F.transform(members, lambda t: F.trim(t)), lambda t: t != "")).when(
        trees.items(value).isNotNull(), F.transform(F.filter(S._list(value), S.truthy), lambda x: F.trim(S.printed(x)))).otherwise(cut(S.printed(value)))


def place(value: Column) -> Column:
    """Parts of a location given as text or as an object."""
    def of_object(name: str) -> Column:
        return F.coalesce(S.printed(F.try_element_at(trees.members(value), F.lit(name))), F.lit("")).alias(name)

    return F.when(trees.members(value).isNotNull(), F.struct(*[of_object(x) for x in S.LOCATION_PARTS])).otherwise(T.location_parts(S.printed(value)))


#: Transform of a target by its last part; everything else is taken as it is.
TRANSFORMS: list[tuple[str, Callable[[Column], Column]]] = [
    (r"^skills\.|\.(domainExperience|industriesWorked|languagesKnown)$", lambda v: F.to_variant_object(split_list(v))),
    (r"\.currentLocation$", lambda v: F.to_variant_object(place(v))),
    (r"ExperienceYears$", lambda v: T.duration_parts(S.printed(v))["years"].cast("variant")),
    (r"ExperienceMonths$", lambda v: T.duration_parts(S.printed(v))["months"].cast("variant")),
    (r"\.dateOfBirth$", lambda v: F.trim(S.printed(v)).cast("variant")),
]


def map_channel(df: DataFrame, channel: str, *, document: str = "payload") -> DataFrame:
    """M3: adds ``record`` (variant: the filled targets of the channel) and ``missing_mandatory``.

    A target takes the first of its names with a value (not null, '' or []), through the target's transform. Text that is
    not a JSON object fills nothing. Columns named ``record`` or ``missing_mandatory`` are replaced.
    """
    table = CHANNELS[SAME_TABLE.get(channel, channel)]
    given = F.col("_given")

    def value(target: str, names: list[str]) -> Column:
        def filled(name: str) -> Column:
            x = F.try_element_at(given, F.lit(name))
            return F.when(~F.to_json(x).isin("null", '""', "[]"), x)

        found = F.coalesce(*[filled(n) for n in names])
        change = next((f for pattern, f in TRANSFORMS if re.search(pattern, target)), None)
        return F.when(found.isNotNull(), change(found)) if change else found

    values = {target: value(target, names) for target, names in table.items()}
    held = df.withColumn("_given", S._object(F.try_parse_json(document))).withColumn("_values", F.struct(*[v.alias(t.replace(".", "_")) for t, v in values.items()]))

    def got(target: str) -> Column:
        return F.col("_values")[target.replace(".", "_")]

    def group(fields: dict[str, Column]) -> Column:
        return S._made(F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*fields.values())))

    roots: dict[str, Column] = {}
    for root in dict.fromkeys(t.split(".")[0] for t in table):
        below = {t.split(".", 1)[1]: got(t) for t in table if "." in t and t.split(".")[0] == root}
        roots[root] = F.when(F.coalesce(*below.values()).isNotNull(), group(below)) if below else got(root)
    missing = F.array_compact(F.array(*[F.when(got(t).isNull(), F.lit(t)) for t in MANDATORY]))
    return held.withColumns({"record": group(roots), "missing_mandatory": missing}).drop("_given", "_values")
