"""Hand-labelled pairs of company records; fixed values."""

# (whether both are one company, one record, the other); a record is (name, domain, description, people)
PAIRS = [
    (True, ('Acme, Inc.', 'acme.com', 'AI-powered widget analytics platform for logistics teams', None), ('Acme AI', None, 'AI powered widget analytics for logistics operations teams', None)),
    (True, ('acme.com', 'acme.com', 'widget analytics for logistics', None), ('Acme, Inc.', 'www.acme.com', 'widget analytics for logistics teams', None)),
    (True, ('TechFlow LLC', 'techflow.io', 'workflow automation for finance teams', None), ('TechFlow', 'techflow.io', 'workflow automation software for finance', None)),
    (True, ('Café Analytics S.A.', 'cafeanalytics.com', 'point of sale analytics for coffee shops', None), ('Cafe Analytics', 'cafeanalytics.com', 'point-of-sale analytics for coffee shop chains', None)),
    (True, ('DataPeak Inc.', 'datapeak.ai', 'observability platform for data pipelines', None), ('DataPeak', 'datapeak.ai', 'observability for data pipelines and warehouses', None)),
    (True, ('Loglane', 'loglane.com', 'structured logging and tracing for microservices', None), ('Loglane Analytics', None, 'structured logging tracing microservices observability', None)),
    (True, ('Nimbus Robotics Ltd', 'nimbusrobotics.com', 'warehouse picking robots', None), ('Nimbus Robotics', 'nimbusrobotics.com', 'autonomous warehouse picking robots', None)),
    (True, ('GreenGrid S.R.L.', 'greengrid.energy', 'residential solar battery scheduling', None), ('GreenGrid', 'greengrid.energy', 'solar battery scheduling for homes', None)),
    (True, ('PixelForge GmbH', 'pixelforge.dev', 'collaborative design tool for game artists', None), ('PixelForge', 'pixelforge.dev', 'collaborative design tooling for game artists', None)),
    (True, ('Northwind Labs', 'northwind.dev', 'developer tooling for API testing', ['Sam Rivera']), ('Northwind Labs Inc', None, 'developer tools for API testing and mocking', ['Sam Rivera'])),
    (True, ('Quanta Health', 'quantahealth.io', 'remote patient monitoring platform', None), ('Quanta Health, Inc.', 'www.quantahealth.io', 'remote patient monitoring for clinics', None)),
    (True, ('BrightPath Robotics', 'brightpath.ai', 'agricultural harvesting robots', None), ('Brightpath robotics', 'brightpath.ai', 'autonomous agricultural harvesting robots', None)),
    (True, ('Solace Systems', None, 'customer support ticketing for SMBs', ['Maria Chen']), ('Solace Systems Inc', None, 'support ticketing software for small businesses', ['Maria Chen'])),
    (True, ('Vertex Dynamics', 'vertexdynamics.io', 'physics simulation engine for game studios', None), ('Vertex Dynamics, LLC', 'www.vertexdynamics.io', 'physics simulation for game studios', None)),
    (True, ('Orbital Fauna', 'orbitalfauna.com', 'wildlife tracking sensors for conservation', None), ('Orbital Fauna Inc', 'orbitalfauna.com', 'wildlife tracking sensor network for conservation', None)),
    (False, ('Acme Plumbing', 'acmeplumbing.com', 'residential plumbing repair and installation', None), ('Acme Robotics', 'acmerobotics.io', 'industrial welding robots for automotive plants', None)),
    (False, ('Vercel', 'vercel.com', 'frontend cloud platform for deploying web apps', None), ('Verceld', 'verceld.io', 'veterinary clinic scheduling software', None)),
    (False, ('Nimbus Robotics', 'nimbusrobotics.com', 'warehouse picking robots', None), ('Nimbus Cloud', 'nimbuscloud.io', 'managed Kubernetes hosting for startups', None)),
    (False, ('DevTools', 'devtools-demo.github.io', 'browser extension for inspecting REST API calls', None), ('DevToolsPro', 'devtoolspro.vercel.app', 'invoice generator for freelance designers', None)),
    (False, ('Quanta Health', 'quantahealth.io', 'remote patient monitoring platform', None), ('Quanta Finance', 'quantafinance.io', 'small business bookkeeping automation', None)),
    (False, ('BrightPath Robotics', 'brightpath.ai', 'agricultural harvesting robots', None), ('BrightPath Media', 'brightpathmedia.io', 'podcast production and distribution studio', None)),
    (False, ('Solstice Labs', 'solsticelabs.com', 'clinical trial data management software', None), ('Solstice Robotics', 'solsticerobotics.io', 'drone inspection for solar farms', None)),
    (False, ('Loglane', 'loglane.com', 'structured logging and tracing for microservices', None), ('Loglabs', 'loglabs.io', 'payroll and benefits administration for remote teams', None)),
    (False, ('PixelForge', 'pixelforge.dev', 'collaborative design tool for game artists', None), ('PixelWorks', 'pixelworks.io', '3D printing marketplace for hobbyists', None)),
    (False, ('Northwind Labs', 'northwind.dev', 'developer tooling for API testing', None), ('Northwind Realty', 'northwindrealty.com', 'residential real estate listing platform', None)),
    (False, ('GreenGrid', 'greengrid.energy', 'residential solar battery scheduling', None), ('GreenGrid Foods', 'greengridfoods.com', 'vertical farming produce delivery subscription', None)),
    (False, ('DataPeak', 'datapeak.ai', 'observability platform for data pipelines', None), ('DataPeak Realty', 'datapeakrealty.com', 'commercial real estate brokerage analytics', None)),
    (False, ('Orbital Fauna', 'orbitalfauna.com', 'wildlife tracking sensors for conservation', None), ('Orbital Systems', 'orbitalsystems.io', 'satellite ground station scheduling software', None)),
    (False, ('TechFlow', 'techflow.io', 'workflow automation for finance teams', None), ('TechFlow Media', 'techflowmedia.com', 'video editing services for YouTube creators', None)),
    (False, ('Solace Systems', 'solacesystems.com', 'customer support ticketing for SMBs', None), ('Zephyr Freight', 'zephyrfreight.io', 'long-haul trucking dispatch optimization', None)),
    (True, ('Acme Consulting Ltd', 'acme.co.uk', 'management consulting for logistics firms', None), ('Acme Consulting', 'www.acme.co.uk', 'management consulting for the logistics sector', None)),
    (False, ('Acme Consulting', 'acme.co.uk', 'management consulting for logistics firms', None), ('Orbit Robotics', 'other-thing.co.uk', 'industrial robotics for automotive assembly', None)),
]
