"""Fixed values that the results depend on.

FIXED VALUES: these strings must stay exactly as written (they are data
values found in ball-by-ball sources and the labels the reports use).
"""

from __future__ import annotations

# --- fixed values: extras that still count as a legal delivery ---------------
LEGAL_EXTRAS = ("byes", "legbyes", "penalty")

# --- fixed values: dismissal kinds -------------------------------------------
# Not credited to the bowler in wicket leaderboards.
NOT_BOWLER_WICKET = "run out"
# Excluded from batter-versus-bowler face-offs.
FACEOFF_EXCLUDED_KINDS = (
    "run out",
    "retired hurt",
    "hit wicket",
    "retired out",
    "obstructing the field",
)
CAUGHT = "caught"
STUMPED = "stumped"

# --- fixed values: team aliases (old name -> current name) -------------------
TEAM_ALIASES = {
    "Kings XI Punjab": "Punjab Kings",
    "Royal Challengers Bangalore": "Royal Challengers Bengaluru",
    "Rising Pune Supergiant": "Rising Pune Supergiants",
}

# --- fixed values: venue aliases (spelling found in sources -> one name) -----
VENUE_ALIASES = {
    "M Chinnaswamy Stadium": "M Chinnaswamy Stadium, Bengaluru",
    "M.Chinnaswamy Stadium": "M Chinnaswamy Stadium, Bengaluru",
    "Himachal Pradesh Cricket Association Stadium": "Himachal Pradesh Cricket Association Stadium, Dharamsala",
    "Sardar Patel Stadium, Motera": "Narendra Modi Stadium, Ahmedabad",
    "Punjab Cricket Association Stadium, Mohali": "Punjab Cricket Association IS Bindra Stadium, Mohali",
    "Punjab Cricket Association IS Bindra Stadium": "Punjab Cricket Association IS Bindra Stadium, Mohali",
    "Punjab Cricket Association IS Bindra Stadium, Mohali, Chandigarh": "Punjab Cricket Association IS Bindra Stadium, Mohali",
    "Maharashtra Cricket Association Stadium": "Maharashtra Cricket Association Stadium, Pune",
    "Subrata Roy Sahara Stadium": "Maharashtra Cricket Association Stadium, Pune",
    "Eden Gardens": "Eden Gardens, Kolkata",
    "Arun Jaitley Stadium": "Arun Jaitley Stadium, Delhi",
    "Feroz Shah Kotla": "Arun Jaitley Stadium, Delhi",
    "Rajiv Gandhi International Stadium, Uppal": "Rajiv Gandhi International Stadium, Uppal, Hyderabad",
    "Rajiv Gandhi International Stadium": "Rajiv Gandhi International Stadium, Uppal, Hyderabad",
    "Wankhede Stadium": "Wankhede Stadium, Mumbai",
    "Dr DY Patil Sports Academy": "Dr DY Patil Sports Academy, Mumbai",
    "Zayed Cricket Stadium, Abu Dhabi": "Sheikh Zayed Stadium",
    "MA Chidambaram Stadium, Chepauk": "MA Chidambaram Stadium, Chepauk, Chennai",
    "MA Chidambaram Stadium": "MA Chidambaram Stadium, Chepauk, Chennai",
    "Sawai Mansingh Stadium": "Sawai Mansingh Stadium, Jaipur",
    "Dr. Y.S. Rajasekhara Reddy ACA-VDCA Cricket Stadium": "Dr. Y.S. Rajasekhara Reddy ACA-VDCA Cricket Stadium, Visakhapatnam",
}

# --- fixed values: the ten-team panel of the per-over run-rate report --------
TEAM_PANEL = (
    "Sunrisers Hyderabad",
    "Chennai Super Kings",
    "Kolkata Knight Riders",
    "Royal Challengers Bengaluru",
    "Delhi Capitals",
    "Mumbai Indians",
    "Gujarat Titans",
    "Lucknow Super Giants",
    "Rajasthan Royals",
    "Punjab Kings",
)

# --- fixed values: season labels in display order ----------------------------
SEASON_ORDER = (
    "2007/08", "2009", "2009/10", "2011", "2012", "2013", "2014", "2015",
    "2016", "2017", "2018", "2019", "2020/21", "2021", "2022", "2023", "2024",
)

# --- fixed values: labels -----------------------------------------------------
ALL_TEAMS = "All_Teams"
MARGIN_HIGH, MARGIN_MEDIUM, MARGIN_LOW, NO_RESULT = "High", "Medium", "Low", "No Result"
RESULT_RUNS, RESULT_WICKETS = "runs", "wickets"
LABEL_JOINER = " in "
# least margin of each label, by kind of result
MARGINS = {
    RESULT_RUNS: {MARGIN_HIGH: 100, MARGIN_MEDIUM: 50, MARGIN_LOW: 1},
    RESULT_WICKETS: {MARGIN_HIGH: 8, MARGIN_MEDIUM: 4, MARGIN_LOW: 1},
}

# --- fixed values: match shape (overs are zero-based, 20 per innings; a phase
# is 4 overs), power-play bounds and board length ------------------------------
OVERS_PER_INNINGS = 20
OVERS_PER_PHASE = 4
BALLS_PER_OVER = 6
POWERPLAY_LAST_OVER = 6          # `over <= 6` on zero-based overs
POWERPLAY_MIN_OVERS = 50
TOP_K = 10
