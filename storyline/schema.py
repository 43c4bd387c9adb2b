"""Schemas of the catalog tables, as Spark DDL. library_id is the unit of parallelism and part of every key."""

PHOTOS = """library_id string, content_hash binary, format string, width int, height int, orientation smallint,
    taken_at timestamp_ntz, taken_offset smallint, date_source string, camera_make string, camera_model string,
    gps_lat double, gps_lon double, phash bigint, duplicate_of binary, has_thumbnail boolean,
    q_sharp double, q_exposure double, q_color double, q_skin double, q_motion double, q_noise double, q_cast double,
    faces_done boolean, faces_model string"""
SOURCES = "library_id string, id bigint, kind string, path string, label string, added_at timestamp"
FILES = "library_id string, id bigint, source_id bigint, rel_path string, size bigint, modified bigint, status string, content_hash binary"
SCANNED = "library_id string, rel_path string, size bigint, modified bigint, status string"
FACES = """library_id string, id bigint, content_hash binary, x double, y double, w double, h double, landmarks array<float>, score double,
    sharpness double, embedding array<float>, grp bigint, person_id bigint, confirmed boolean, ignored boolean"""
PERSONS = "library_id string, id bigint, name string, role string, important boolean, birth_date date"
RELATIONS = "library_id string, person_id bigint, kind string, other_id bigint, status string, learned_year int"
OVERRIDES = "library_id string, album_year int, content_hash binary, action string, created_at timestamp"
FEEDBACK = "library_id string, id bigint, album_year int, action string, content_hash binary, other_hash binary, reason string"
COMMENTS = "library_id string, id bigint, album_year int, target_kind string, target_id string, kind string, text string"
GOLD = "library_id string, name string, year int, content_hash binary, page int, idx int, distance int, status string"

#: Fixed values of the face groups' number ranges: person ids stand below, new groups from the second on.
IGNORED_GROUP, FIRST_UNNAMED = 999_999, 1_000_000
