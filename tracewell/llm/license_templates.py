"""Templates of licence notices: (id, licence, text).

Fixed values: notices as their licences ask for them or as they are commonly
written. A scan takes any table of this shape.
"""

TEMPLATES = [
    (1, "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (2, "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    (3, "Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    (4, "MIT", "Released under the MIT License."),
    (5, "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    (6, "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (7, "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    (8, "GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    (9, "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (10, "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (11, "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (12, "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (13, "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
