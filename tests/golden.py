"""Lines with their exact redacted form under one salt. They must equal the published pairs."""

SALT = "integration-test-salt-1234567890"

PAIRS = [
    ('{"ts": 1700000000, "msg": "hello", "password": "secret_pass_123!"}', '{"ts": 1700000000, "msg": "hello", "password": "[HIDDEN:64ec17]"}'),
    ("Log line with key=123456 and token=abcdef", "Log line with key=[HIDDEN:54443f] and token=[HIDDEN:abd62a]"),
    ("User session active: jwt=eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.e30.secret_signature", "User session active: jwt=[HIDDEN:062bf9]"),
    ('{"context": {"user": {"api_key": "sk_live_multi_level_json_secret"}}}', '{"context": {"user": {"api_key": "[HIDDEN:69dbd3]"}}}'),
    (r'{"prompt": "User said \"my pass is 123456\""}', r'{"prompt": "User said \"my pass is 123456\""}'),
    ("GET /api/v1/user?token=abcdef123456&uid=123", "GET /api/v1/user?token=[HIDDEN:16cae9]&uid=123"),
    ("Safe data check: uuid=550e8400-e29b-41d4-a716-446655440000 git_sha=a1b2c3d4e5f6", "Safe data check: uuid=550e8400-e29b-41d4-a716-446655440000 git_sha=[HIDDEN:9c0cf2]"),
]
