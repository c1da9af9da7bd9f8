"""Closed vocabularies of the data model (fixed values)."""

ENTITY_TYPES = (
    "Person", "HealthCondition", "Medication", "PsychologicalPattern", "Preference", "Tool", "Skill", "Infrastructure",
    "Project", "Organisation", "Place", "Identity", "Routine", "Media", "InteractionPattern", "Milestone",
)

RELATION_TYPES = (
    "has_condition", "treated_by", "prescribed_by", "triggers", "caused_by", "connected_to", "works_at", "member_of", "uses", "built_on", "part_of",
    "prefers", "avoids", "lives_in", "knows", "treats", "identifies_as", "follows", "manages", "relates_to", "supersedes",
)

EXCLUSIVE_RELATIONS = ("works_at", "member_of", "lives_in")

# the type a relation suggests for its source and for its target
SOURCE_HINTS = {
    "has_condition": "Person", "works_at": "Person", "member_of": "Person", "lives_in": "Person", "knows": "Person", "identifies_as": "Person", "follows": "Person",
    "prefers": "Person", "avoids": "Person", "uses": "Person", "treats": "Person", "built_on": "Project", "part_of": "Infrastructure", "manages": "HealthCondition",
}
TARGET_HINTS = {
    "has_condition": "HealthCondition", "treated_by": "Medication", "prescribed_by": "Person", "works_at": "Organisation", "member_of": "Organisation", "lives_in": "Place", "knows": "Person",
    "identifies_as": "Identity", "follows": "Routine", "prefers": "Preference", "uses": "Tool", "built_on": "Tool", "treats": "Person", "manages": "Routine",
}

# what a name contains, in lower case, and the type it suggests
NAME_HINTS = {
    "dr ": "Person", "dr.": "Person", " mg": "Medication", "adhd": "HealthCondition", "asd": "HealthCondition", "pots": "HealthCondition", "anxiety": "PsychologicalPattern",
    "depression": "PsychologicalPattern", "schema": "PsychologicalPattern", "nix": "Tool", "neovim": "Tool", "vim": "Tool", "docker": "Tool", "melbourne": "Place", "australia": "Place", "autograb": "Organisation",
}

SPEAKERS = {1: "User", 2: "Assistant"}
EXISTING_THRESHOLD, NEW_THRESHOLD, FUZZY_THRESHOLD = 0.7, 0.85, 0.6
